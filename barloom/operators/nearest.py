"""Exact nearest vectors by cosine: lists around pivots, visited only where the triangle inequality leaves something to find."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType
from pyspark.sql.window import Window

from ..sources.storage import stored

PIVOTS, NUMBERS = 2_048, 4_000_000  # most pivots, and most numbers that they hold together: 32 MB
RING = 0.05  # width of a ring around a pivot, in distance of unit vectors; a list has at most 41
BIN, QUERY_BLOCK = 8_192, 2_048  # vectors and queries of a task
SLACK = 1e-6  # far over what rounding does to a distance
ELSEWHERE = -1  # the list of vectors of other lengths than the pivots'


def usable(vector: str) -> Column:
    """Neither NULL nor empty, without NULL or non-finite components, not zero."""
    square = F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return (square > 0) & (square < float("inf"))


def _matrix(vectors) -> np.ndarray:
    return np.stack([np.asarray(v, dtype="float64") for v in vectors])


def _units(m: np.ndarray) -> np.ndarray:
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def _distances(units: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * units @ pivots.T, 0))


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, added from left to right as an aggregate does, so that equal vectors tie exactly wherever they lie."""
    return np.cumsum(a * b, axis=1)[:, -1] if len(a) else np.zeros(0)


@dataclass
class Lists:
    """Vectors (owner_id, embedding, segment, bin) and the directory of their segments: a list's ring each, in one bin or in several if it is large."""

    vectors: DataFrame
    pivots: np.ndarray
    directory: pd.DataFrame  # list, ring, n, low, high, first_bin, parts; the row's place is the segment


def build(rows: DataFrame, pivot_count: int | None = None, bin_rows: int = BIN) -> Lists:
    """Lists of the rows (owner_id, embedding); each is in the list of its nearest pivot, in the ring of its distance.

    Pivots are vectors of the most frequent length, drawn by a hash of the id: half
    the root of the number of vectors, at most PIVOTS and NUMBERS. Vectors of another
    length are in one more list, which queries of other lengths visit. Rows without
    an id, and vectors that are not `usable`, take no part. The directory has at
    most 41 rows a pivot.
    """
    rows = rows.select("owner_id", "embedding").where(F.col("owner_id").isNotNull() & usable("embedding"))
    lengths = rows.groupBy(F.size("embedding").alias("dims")).count().orderBy(F.desc("count"), "dims").first()
    dims, count = (lengths["dims"], lengths["count"]) if lengths else (1, 0)
    wanted = pivot_count or int(np.ceil(np.sqrt(count) / 2))
    wanted = max(1, min(wanted, PIVOTS, NUMBERS // dims))
    drawn = rows.where(F.size("embedding") == dims).orderBy(F.xxhash64("owner_id"), "owner_id").limit(wanted).collect()
    pivots = np.unique(_units(_matrix([r["embedding"] for r in drawn])), axis=0) if drawn else np.zeros((0, dims))

    def assign(batches):
        for batch in batches:
            batch["list"], batch["distance"] = ELSEWHERE, 0.0
            fits = np.array([len(v) == dims for v in batch["embedding"]], dtype=bool)
            if len(pivots) and fits.any():
                d = _distances(_units(_matrix(batch["embedding"][fits])), pivots)
                batch.loc[fits, "list"] = d.argmin(axis=1)
                batch.loc[fits, "distance"] = d.min(axis=1)
            batch["ring"] = (batch["distance"] / RING).astype("int32")
            yield batch

    schema = rows.select("*", F.lit(0).alias("list"), F.lit(0.0).alias("distance"), F.lit(0).alias("ring")).schema
    placed = stored(rows.mapInPandas(assign, schema), "vector-lists")
    directory = placed.groupBy("list", "ring").agg(F.count("*").alias("n"), F.min("distance").alias("low"), F.max("distance").alias("high")).orderBy("list", "ring").toPandas()
    directory["parts"] = np.maximum(1, -(-directory["n"] // bin_rows))
    # neighbouring rings share a bin until it is full; a ring over a bin's size is cut by hash into bins of its own
    first, at, room = [], 0, bin_rows
    for n, parts in zip(directory["n"], directory["parts"]):
        if n > room and room < bin_rows:
            at, room = at + 1, bin_rows
        first.append(at)
        at, room = (at + parts, bin_rows) if parts > 1 else (at, room - n)
    directory["first_bin"] = np.array(first, dtype="int64")
    spark = rows.sparkSession
    places = [(int(r.list), int(r.ring), k, int(r.first_bin), int(r.parts)) for k, r in enumerate(directory.itertuples())]
    table = F.broadcast(spark.createDataFrame(places, "list int, ring int, segment int, first_bin long, parts long"))
    part = F.pmod(F.xxhash64("owner_id"), F.col("parts"))
    vectors = placed.join(table, ["list", "ring"]).select("owner_id", "embedding", "segment", (F.col("first_bin") + part).alias("bin"))
    return Lists(vectors, pivots, directory)


def _bounds(pivots: np.ndarray, found: pd.DataFrame, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each query and segment: a distance that no vector of the segment is under, and the distance of the pivot."""
    d = _distances(units, pivots)
    near = d.argmin(axis=1)
    between = _distances(pivots[near], pivots)
    # what is nearer to another pivot than to the query's own lies behind the plane halfway between them
    plane = (d**2 - d.min(axis=1, keepdims=True) ** 2) / np.maximum(2 * between, 1e-9)
    plane[between < SLACK] = 0
    of = found["list"].to_numpy()
    own = d[:, of]
    bound = np.maximum(np.maximum(own - found["high"].to_numpy(), found["low"].to_numpy() - own), plane[:, of])
    bound[:, of == ELSEWHERE] = np.inf
    return np.maximum(bound - SLACK, 0), own


def visits(lists: Lists, queries: DataFrame, first: int) -> DataFrame:
    """(query_id, query, bin, segments, pairs) to visit: for rows without a `reach` what is nearest, `first` vectors at least; else all else within reach.

    Queries are rows (query_id, query, reach); reach is a distance, infinite
    where fewer vectors than were asked for have been found.
    """
    found, pivots = lists.directory, lists.pivots
    if found.empty:
        return queries.select("query_id", "query", F.lit(0).cast("long").alias("bin"), F.array().cast("array<int>").alias("segments"), F.lit(0).cast("long").alias("pairs")).where("false")
    n, elsewhere = found["n"].to_numpy(), (found["list"] == ELSEWHERE).to_numpy()
    bins, parts = found["first_bin"].to_numpy(), found["parts"].to_numpy()
    chunk = max(1, NUMBERS // len(found))

    def choose(units, reach):
        bound, own = _bounds(pivots, found, units)
        chosen = np.zeros(bound.shape, dtype=bool)
        for k in range(len(units)):
            order = np.lexsort((own[k], bound[k]))
            before = np.cumsum(n[order]) - n[order]
            opening = order[(before < first) & np.isfinite(bound[k][order])]
            if np.isnan(reach[k]):
                chosen[k, opening] = True
            else:
                chosen[k] = (bound[k] <= reach[k]) & np.isfinite(bound[k])
                chosen[k, opening] = False
        return chosen

    def plan(batches):
        for batch in batches:
            for start in range(0, len(batch), chunk):
                piece = batch.iloc[start : start + chunk].reset_index(drop=True)
                reach = piece["reach"].to_numpy(dtype="float64", na_value=np.nan)
                fits = np.array([len(v) == pivots.shape[1] for v in piece["query"]], dtype=bool)
                chosen = np.zeros((len(piece), len(found)), dtype=bool)
                chosen[~fits] = elsewhere & np.isnan(reach[~fits])[:, None]
                if fits.any():
                    chosen[fits] = choose(_units(_matrix(piece["query"][fits])), reach[fits])
                rows = []
                for k in range(len(piece)):
                    held: dict[int, list[int]] = {}
                    for s in np.flatnonzero(chosen[k]):
                        for b in range(bins[s], bins[s] + parts[s]):
                            held.setdefault(int(b), []).append(int(s))
                    rows += [(k, b, segments, int(sum(-(-n[s] // parts[s]) for s in segments))) for b, segments in held.items()]
                if rows:
                    at = [r[0] for r in rows]
                    yield pd.DataFrame({
                        "query_id": piece["query_id"].iloc[at].to_numpy(), "query": [piece["query"].iloc[k] for k in at],
                        "bin": [r[1] for r in rows], "segments": [r[2] for r in rows], "pairs": [r[3] for r in rows],
                    })

    schema = queries.select("query_id", "query", F.lit(0).cast("long").alias("bin"), F.array(F.lit(0)).alias("segments"), F.lit(0).cast("long").alias("pairs")).schema
    return queries.select("query_id", "query", "reach").mapInPandas(plan, schema)


def _meet(lists: Lists, visited: DataFrame, k: int, blocks: int) -> DataFrame:
    """(query_id, owner_id, similarity): the k nearest of each query in each bin that it visits."""

    def best(vectors: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        vectors = vectors.sort_values("owner_id", kind="stable")
        lengths = vectors["embedding"].map(len).to_numpy()
        asked_lengths = asked["query"].map(len).to_numpy()
        for length in np.unique(lengths):
            mine, some = vectors[lengths == length], asked[asked_lengths == length]
            if some.empty:
                continue
            m, segment, owners = _matrix(mine["embedding"]), mine["segment"].to_numpy(), mine["owner_id"].to_numpy()
            units, squares = _units(m), _dots(m, m)
            step = max(1, NUMBERS // len(m))
            for start in range(0, len(some), step):
                piece = some.iloc[start : start + step]
                q = _matrix(piece["query"])
                about = _units(q) @ units.T
                for i in range(len(piece)):
                    inside = np.flatnonzero(np.isin(segment, piece["segments"].iloc[i]))
                    if len(inside) > k:
                        s = about[i, inside]
                        inside = inside[s >= np.partition(s, len(s) - k)[len(s) - k] - 1e-9]
                    a = np.broadcast_to(q[i], (len(inside), length))
                    exact = _dots(m[inside], a) / np.sqrt(squares[inside] * _dots(q[i : i + 1], q[i : i + 1]))
                    top = np.argsort(-exact, kind="stable")[:k]
                    out.append((np.repeat(piece["query_id"].to_numpy()[i : i + 1], len(top)), owners[inside[top]], exact[top]))
        names = ["query_id", "owner_id", "similarity"]
        return pd.DataFrame({name: np.concatenate(column) for name, column in zip(names, zip(*out))}) if out else pd.DataFrame(columns=names)

    block = F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")
    asked = stored(visited.withColumn("block", block), "vector-visits")
    wanted = asked.select(F.col("bin").alias("for_bin"), F.col("block").alias("for_block")).distinct()
    vectors = lists.vectors.join(wanted, F.col("bin") == F.col("for_bin"))
    schema = StructType([visited.schema["query_id"], vectors.schema["owner_id"], StructField("similarity", DoubleType())])
    return vectors.groupBy("for_bin", "for_block").cogroup(asked.groupBy("bin", "block")).applyInPandas(best, schema)


def search(rows: DataFrame, queries: DataFrame, k: int, lists: Lists | None = None, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, owner_id, similarity): the k nearest rows (owner_id, embedding) of each query (query_id, query) by cosine, ties by id.

    Each query first visits the segments nearest to it, which hold 8 k vectors or
    more. The k-th best of these says how far any better one can be, and the
    second pass visits only the segments that reach so near: by a list's rings
    and by the plane between two pivots, so nothing is lost. Where vectors lie in
    clusters few pairs are left. At worst, with vectors at random in many
    dimensions, all segments are near and every query meets every row, in blocks
    of BIN rows and `query_block` queries, a task each. A vector meets only those
    of its own length. Ids of queries are unique.
    """
    lists = lists or build(rows)
    asked = queries.select("query_id", "query").where(F.col("query_id").isNotNull() & usable("query"))
    blocks = max(1, -(-asked.count() // query_block))
    opening = visits(lists, asked.withColumn("reach", F.lit(None).cast("double")), 8 * k)
    first = stored(_meet(lists, opening, k, blocks), "vector-first")
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "owner_id"))
    kth = first.withColumn("rank", best).where(F.col("rank") == k).select("query_id", F.sqrt(F.greatest(2 - 2 * F.col("similarity"), F.lit(0.0))).alias("reach"))
    reached = asked.join(kth, "query_id", "left").withColumn("reach", F.coalesce("reach", F.lit(float("inf"))))
    rest = _meet(lists, visits(lists, reached, 8 * k), k, blocks)
    return first.unionByName(rest).withColumn("rank", best).where(F.col("rank") <= k).select("query_id", "rank", "owner_id", "similarity")
