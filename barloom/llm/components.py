"""Connected components of an edge table, as joins and minima on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def connected_components(edges: DataFrame, name: str = "components", rounds: int = 100) -> DataFrame:
    """(node, component) for every node of `edges` (columns a, b: long); component is the smallest node reached.

    Each round takes the least label among the neighbours and then follows that
    label's own label (pointer jumping), so long paths need few rounds. Labels
    and edges are tables of their own, so that both inputs of each join are
    plain exchanges and Spark can split a hub's partition. Self-loops are
    ignored; an empty edge table gives an empty result.
    """
    edges = edges.where("a <> b").select("a", "b")
    both = materialize(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-edges")
    start = both.groupBy("a").agg(F.min("b").alias("low"))
    labels = materialize(start.select(F.col("a").alias("node"), F.least("a", "low").alias("label"), F.lit(True).alias("moved")), name)
    for _ in range(rounds):
        if labels.isEmpty():
            break
        offered = (
            both.join(labels.select(F.col("node").alias("b"), "label"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("label").alias("offer"))
        )
        nearer = labels.join(offered, "node").select("node", F.col("label").alias("old"), F.least("label", "offer").alias("label"))
        nearer = materialize(nearer, f"{name}-nearer")
        roots = nearer.select(F.col("node").alias("label"), F.col("label").alias("root"))
        labels = nearer.join(roots, "label").select("node", F.col("root").alias("label"), (F.col("root") != F.col("old")).alias("moved"))
        labels = materialize(labels, name)
        if labels.where("moved").isEmpty():
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return labels.select("node", F.col("label").alias("component"))
