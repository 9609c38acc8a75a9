"""Nearest neighbours by a permutation index: vectors as ordered pivots, inverted files, footrule distance, exact rerank."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from .common import materialize

#: Pivots of a shard; places of a vector's permutation that are posted, and pivots whose lists a query reads, as shares of the pivots.
PIVOTS, POSTED, READ = 256, 0.5, 0.25
#: A shard holds about so many numbers, a block of queries a quarter of them.
SHARD_VALUES = 1 << 20
#: Vectors that are reranked for each query: this many times the root of the rows of its kind, and at least LEAST in a shard.
RERANK, LEAST = 8.0, 512
#: Rows of one kind have about this ratio of length.
RATIO = 1.1
#: Kinds whose sizes are sent to all tasks, at most; more are joined by a shuffle.
FEW = 10_000


def usable(vectors: DataFrame, id_col: str, embedding_col: str) -> DataFrame:
    """(vec_id, vec, dim, kind): rows that take part; kind numbers lengths by their logarithm."""
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{embedding_col}`").cast("array<double>").alias("vec"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.coalesce(F.col("vec_id").isNotNull() & finite & F.exists("vec", lambda x: x != 0), F.lit(False)))
    top = F.array_max(F.transform("vec", F.abs))
    # the largest component is taken out first, so that no square overflows
    square = F.aggregate("vec", F.lit(0.0), lambda a, x: a + (x / top) * (x / top))
    length = F.log(top) + F.log(square) / 2
    return rows.select("vec_id", "vec", F.size("vec").alias("dim"), F.rint(length / float(np.log(RATIO))).cast("int").alias("kind"))


def _unit(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def places(vectors: np.ndarray, pivots: np.ndarray, kept: int) -> np.ndarray:
    """For each vector the place of each pivot when pivots are ordered by nearness, and `kept` for all that come later."""
    near = -(_unit(vectors) @ pivots.T)
    order = np.argsort(near, axis=1, kind="stable")[:, :kept]
    out = np.full(near.shape, kept, np.uint8)
    np.put_along_axis(out, order, np.arange(order.shape[1], dtype=np.uint8)[None, :], 1)
    return out


def _index(rows: pd.DataFrame) -> pd.DataFrame:
    """Post one shard: every row with its place in the list of each pivot; the pivots are its own first rows by a hash."""
    rows = rows.sort_values(["draw", "node"], ignore_index=True)
    vectors = np.stack(rows["vec"].to_numpy())
    n = min(PIVOTS, len(rows))
    posted = places(vectors, _unit(vectors[:n]), max(1, int(n * POSTED)))
    return rows.assign(pivot=np.where(np.arange(len(rows)) < n, np.arange(len(rows)), -1).astype(np.int32), places=[p.tobytes() for p in posted])


def build(vectors: DataFrame, id_col: str = "vec_id", embedding_col: str = "embedding", k: int = 20) -> DataFrame:
    """The index as a table: dim, kind, shard, node, ids, vec, pivot, places, rerank.

    Equal vectors are one node with its smallest k + 1 ids. Nodes of one number
    of components and about one length are dealt by a hash to shards of bounded
    size; each shard has pivots of its own among its nodes and posts all of them.
    """
    rows = usable(vectors, id_col, embedding_col)
    # a group of copies is cut to its smallest ids before it is shuffled
    first = F.row_number().over(Window.partitionBy("dim", "kind", "vec").orderBy("vec_id"))
    kept = rows.distinct().withColumn("_n", first).where(F.col("_n") <= k + 1)
    nodes = kept.groupBy("dim", "kind", "vec").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    nodes = materialize(nodes.withColumn("node", F.col("ids")[0]).withColumn("draw", F.xxhash64("vec", F.lit(13))), "permutation-nodes")
    sizes = nodes.groupBy("dim", "kind").agg(F.count("*").alias("n"))
    sizes = sizes.withColumn("shards", F.ceil(F.col("n") * F.col("dim") / SHARD_VALUES))
    # each shard gives its part of what is reranked, and a quarter more as parts differ
    share = F.ceil(F.when(F.col("shards") > 1, 1.25 * RERANK * F.sqrt("n") / F.col("shards")).otherwise(RERANK * F.sqrt("n")))
    sizes = sizes.withColumn("rerank", F.greatest(share, F.lit(LEAST)).cast("int")).drop("n")
    sizes = materialize(sizes, "permutation-sizes")
    if sizes.count() <= FEW:  # nearly all nodes may have one key
        sizes = F.broadcast(sizes)
    dealt = nodes.join(sizes, ["dim", "kind"]).withColumn("shard", F.pmod(F.xxhash64("draw"), F.col("shards")).cast("int")).drop("shards")
    dealt = dealt.select("dim", "kind", "shard", "node", "ids", "vec", "draw", "rerank")
    index = dealt.groupBy("dim", "kind", "shard").applyInPandas(_index, StructType([*dealt.schema, *StructType.fromDDL("pivot int, places binary")]))
    return materialize(index.drop("draw"), "permutation-index")


def _search(k: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    def run(shard: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        """The k nearest of a shard for each query of a block."""
        columns = ["query_id", "query_node", "vec_id", "score"]
        if shard.empty or queries.empty:
            return pd.DataFrame({c: np.zeros(0, float if c == "score" else np.int64) for c in columns})
        shard = shard.sort_values("node", ignore_index=True)
        vectors = np.stack(shard["vec"].to_numpy())
        asked = np.stack(queries["vec"].to_numpy())
        pivot = shard["pivot"].to_numpy()
        n = int(pivot.max()) + 1
        read = max(1, int(n * READ))
        pivots = vectors[np.argsort(np.where(pivot < 0, n, pivot), kind="stable")[:n]]
        # the inverted file: for each pivot the place of every member
        lists = np.ascontiguousarray(np.frombuffer(b"".join(shard["places"]), np.uint8).reshape(len(shard), n).T)
        nearest = np.argsort(-(_unit(asked) @ _unit(pivots).T), axis=1, kind="stable")[:, :read]
        own_place = np.arange(read, dtype=np.uint8)[:, None]
        take = min(len(shard), int(shard["rerank"].iloc[0]))
        ids = shard["ids"].to_numpy()
        out: list[tuple[int, int, int, float]] = []
        for q, (query, node) in enumerate(zip(queries["query_id"].tolist(), queries["query_node"].tolist(), strict=True)):
            if take < len(shard):
                there = lists[nearest[q]]
                footrule = (np.maximum(there, own_place) - np.minimum(there, own_place)).sum(axis=0, dtype=np.uint16)
                near = np.sort(np.argpartition(footrule, take - 1)[:take])
            else:
                near = np.arange(len(shard))
            score = vectors[near] @ asked[q]
            # a query's own row may be among the first k, and equal scores are told apart by id
            least = np.partition(score, len(score) - k - 1)[len(score) - k - 1] if len(score) > k + 1 else -np.inf
            good = np.flatnonzero(score >= least)
            found = [(-s, int(i)) for s, c in zip(score[good].tolist(), near[good].tolist(), strict=True) for i in ids[c] if i != query]
            out += [(query, node, i, -s) for s, i in sorted(found)[:k]]
        return pd.DataFrame(out, columns=columns)

    return run


def search(index: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", embedding_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of largest inner product found for each query, in double precision.

    Queries meet the shards of their number of components in blocks, a task for
    each block and shard. There a query reads the lists of its nearest pivots,
    adds up the footrule distance of every member over them (a member that is not
    posted counts as one place after the last), and the best are reranked by their
    vectors; ties go to the smaller id. All members of a shard of up to LEAST are
    reranked, so small tables are searched exactly.

    A query's own id is no result. Vectors that are null, zero, empty or hold null
    or non-finite components, and rows without an id, take no part on either side.
    Repeated rows count once; different vectors under one id are each queries and
    results. Equal vectors are ranked by id. An empty table gives no rows.
    """
    asked = usable(queries, id_col, embedding_col).select(F.col("vec_id").alias("query_id"), "vec", "dim").distinct().withColumn("query_node", F.xxhash64("vec"))
    counts = asked.groupBy("dim").agg(F.greatest(F.lit(1), F.ceil(F.count("*") * F.col("dim") * 4 / SHARD_VALUES)).cast("int").alias("blocks"))
    counts = materialize(counts, "permutation-blocks")
    few = F.broadcast(counts) if counts.count() <= FEW else counts
    asked = asked.join(few, "dim").withColumn("block", F.pmod(F.xxhash64("query_id", "query_node"), F.col("blocks").cast("long")).cast("int")).drop("blocks")
    each_block = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    # columns of their own, as the shards meet the index again
    shards = index.select(*[F.col(c).alias(c) for c in ("dim", "kind", "shard")]).distinct().join(few, "dim").select("dim", "kind", "shard", each_block.alias("block"))
    asked = asked.join(shards, ["dim", "block"])
    members = index.join(few, "dim").withColumn("block", each_block).drop("blocks")
    key = ["dim", "kind", "shard", "block"]
    found = members.groupBy(*key).cogroup(asked.groupBy(*key)).applyInPandas(_search(k), "query_id long, query_node long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id", "query_node").orderBy(F.desc("score"), "vec_id"))
    # an id that stands in several rows with different vectors may be found more than once
    best = found.withColumn("rank", rank).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")
