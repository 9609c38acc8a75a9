"""Sums over all subtrees of a forest by parallel tree contraction, in rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def subtree_sums(tree: DataFrame, values: list[str], name: str = "tree", rounds: int = 500) -> DataFrame:
    """(node, *values): each value summed over the node's subtree, itself included.

    `tree` has node (unique long), parent (null for roots) and the long values.
    A round first rakes: every leaf's sums are whole, go to its parent and leave
    the tree. Then it compresses: in a chain of nodes with one child each, those
    go whose drawn number is above their parent's and their child's, so that no
    two neighbours go at once; the child is hung to the grandparent and carries
    what the node holds. About half of a bushy tree and a third of a chain go in
    each round, so the rounds grow with the logarithm of the nodes, however deep
    the tree. Afterwards the compressed nodes are opened again, the latest round
    first: a node's sums are its child's and what it held itself.

    Children are counted and added up with partial aggregates, and no join has a
    key that many rows share on both sides, so a node with a third of all nodes
    as children makes no large task. Each round is a stored table. A node whose
    parent is not in the tree is dropped with its subtree; a cycle raises.
    """
    a, w = [f"a{k}" for k in range(len(values))], [f"w{k}" for k in range(len(values))]
    # a node gives its parent what is in `a` (its subtree so far) and in `w` (what was compressed above it)
    active = tree.select("node", "parent", *[F.col(v).cast("long").alias(x) for v, x in zip(values, a, strict=True)], *[F.lit(0).cast("long").alias(x) for x in w])
    raked: list[DataFrame] = []
    spliced: list[DataFrame] = []
    for number in range(rounds):
        kids = active.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("kids"))
        active = materialize(active.join(kids, "node", "left"), f"{name}-active")
        raked.append(active.where("kids is null").select("node", *a))
        given = [F.coalesce(F.sum(F.when(F.col("kids").isNull(), F.col(x) + F.col(y))), F.lit(0)).alias(f"up_{x}") for x, y in zip(a, w, strict=True)]
        below = active.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(*given, F.count("kids").alias("left"), F.min(F.when(F.col("kids").isNotNull(), F.col("node"))).alias("only"))
        drawn = lambda c: F.xxhash64(F.lit(number), c)  # noqa: B023, E731
        chosen = (F.col("left") == 1) & F.col("parent").isNotNull() & (drawn("node") > drawn("parent")) & (drawn("node") > drawn("only"))
        inner = active.where("kids is not null").drop("kids").join(below, "node")
        inner = inner.select("node", "parent", *[(F.col(x) + F.col(f"up_{x}")).alias(x) for x in a], *w, "only", F.coalesce(chosen, F.lit(False)).alias("chosen"))
        inner = materialize(inner, f"{name}-inner")
        if inner.isEmpty():
            break
        gone = inner.where("chosen").select(F.col("only").alias("node"), F.col("node").alias("over"), F.col("parent").alias("above"), *[F.col(x).alias(f"held_{x}") for x in a], *[F.col(y).alias(f"held_{y}") for y in w])
        moved = inner.where("not chosen").join(gone, "node", "left")
        extra = [F.coalesce(F.col(f"held_{x}") + F.col(f"held_{y}"), F.lit(0)) for x, y in zip(a, w, strict=True)]
        moved = moved.select(
            "node", F.coalesce("above", "parent").alias("parent"), *a,
            *[(F.col(y) + e).alias(y) for y, e in zip(w, extra, strict=True)],
            "over", *[(F.col(f"held_{x}") + F.col(y)).alias(f"more_{x}") for x, y in zip(a, w, strict=True)],
        )
        moved = materialize(moved, f"{name}-moved")
        spliced.append(moved.where("over is not null").select("node", "over", *[f"more_{x}" for x in a]))
        active = moved.select("node", "parent", *a, *w)
    else:
        raise RuntimeError(f"the tree did not contract in {rounds} rounds; it may have a cycle")
    known = raked.pop()
    while spliced:
        opened = spliced.pop().join(known, "node").select(F.col("over").alias("node"), *[(F.col(x) + F.col(f"more_{x}")).alias(x) for x in a])
        known = materialize(known.unionByName(opened).unionByName(raked.pop()), f"{name}-known")
    return known.select("node", *[F.col(x).alias(v) for v, x in zip(values, a, strict=True)])
