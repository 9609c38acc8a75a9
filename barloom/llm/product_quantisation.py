"""Embedding near-duplicates: coarse inverted lists, residual codes, asymmetric distances, exact cosine rerank."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .components import connected_components

LEAST_COSINE = 0.93
#: Vectors that the quantisers are fitted on, at most, and numbers in them; subspaces; codewords of each.
SAMPLE, SAMPLE_VALUES, SUBSPACES, CODEWORDS = 20_000, 1 << 22, 8, 256
#: Vectors of the largest label in a list, on average; rows of a list that one task compares with as many others.
LIST_SIZE, BLOCK = 512, 2048
#: Cells of one level of centroids; with more, each is divided again by centroids of the residuals.
LEVEL = 1024
#: How far beyond the border of its own cell a vector looks for partners, as a share of the largest link distance:
#: an offset's part along the border's normal has a standard deviation of 1 / sqrt(dimensions) of it. A reach of 1 misses nothing.
DEVIATIONS = 2.5
#: Vector lengths that get quantisers of their own; others are compared exactly in one list a label.
MAX_DIMS = 4


def _kmeans(points: np.ndarray, k: int, rounds: int = 12, seed: int = 0) -> np.ndarray:
    k = min(k, len(points))
    centres = points[np.random.default_rng(seed).choice(len(points), k, replace=False)].copy()
    for _ in range(rounds):
        near = _nearest(points, centres)
        count = np.bincount(near, minlength=k)
        total = np.zeros_like(centres)
        np.add.at(total, near, points)
        centres[count > 0] = total[count > 0] / count[count > 0, None]
    return centres


def _nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    square = np.einsum("ij,ij->i", centres, centres)[None, :]
    parts = [(square - 2 * points[k : k + 2048] @ centres.T).argmin(1) for k in range(0, len(points), 2048)]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def _beyond(vectors: np.ndarray, centres: np.ndarray, cell: np.ndarray) -> np.ndarray:
    """How far each vector lies from the border between its own cell and each other one."""
    d = np.einsum("ij,ij->i", centres, centres)[None, :] - 2 * vectors @ centres.T
    own = centres[cell]
    apart = np.sqrt(np.maximum(np.einsum("ij,ij->i", own, own)[:, None] + np.einsum("ij,ij->i", centres, centres)[None, :] - 2 * own @ centres.T, 0))
    return (d - d[np.arange(len(cell)), cell][:, None]) / np.maximum(2 * apart, 1e-12)


class Quantiser:
    """Coarse centroids, on one level or two, and one codebook for each subspace of the residuals, for unit vectors of one length."""

    def __init__(self, sample: np.ndarray, cells: int):
        self.first = _kmeans(sample, max(1, min(cells, LEVEL)))
        near = _nearest(sample, self.first)
        ways = -(-cells // LEVEL)
        self.second = _kmeans(sample - self.first[near], min(ways, max(1, len(sample) // 8)), seed=99) if ways > 1 else np.zeros((1, sample.shape[1]))
        residual = sample - self.centre(self.cells(sample))
        self.parts = [p for p in np.array_split(np.arange(sample.shape[1]), SUBSPACES) if len(p)]
        self.books = [_kmeans(residual[:, p], CODEWORDS, seed=k + 1) for k, p in enumerate(self.parts)]

    def centre(self, cell: np.ndarray) -> np.ndarray:
        return self.first[cell // len(self.second)] + self.second[cell % len(self.second)]

    def cells(self, vectors: np.ndarray) -> np.ndarray:
        one = _nearest(vectors, self.first)
        return one * len(self.second) + _nearest(vectors - self.first[one], self.second)

    def encode(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cell, codes, and how far the decoded vector lies from the true one."""
        cell = self.cells(vectors)
        residual = vectors - self.centre(cell)
        codes = np.stack([_nearest(residual[:, p], b) for p, b in zip(self.parts, self.books, strict=True)], axis=1).astype(np.uint8)
        return cell, codes, np.linalg.norm(vectors - self.decode(cell, codes), axis=1)

    def decode(self, cell: np.ndarray, codes: np.ndarray) -> np.ndarray:
        out = self.centre(cell)
        for k, (p, b) in enumerate(zip(self.parts, self.books, strict=True)):
            out[:, p] += b[codes[:, k]]
        return out

    def probes(self, vectors: np.ndarray, cell: np.ndarray, reach: float) -> list[np.ndarray]:
        """Later cells whose border lies within `reach` of each vector, on both levels."""
        row, one = np.nonzero(_beyond(vectors, self.first, cell // len(self.second)) <= reach)
        moved = vectors[row] - self.first[one]
        at, two = np.nonzero(_beyond(moved, self.second, _nearest(moved, self.second)) <= reach)
        row, found = row[at], one[at] * len(self.second) + two
        row, found = row[found > cell[row]], found[found > cell[row]]
        return np.split(found, np.searchsorted(row, np.arange(1, len(vectors))))

    def asymmetric(self, vectors: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """|x - decoded y| for all x of `vectors` and all y of one cell with `codes`, from tables of inner products."""
        centre = self.centre(np.array([cell]))[0]
        dots = np.repeat((vectors @ centre)[:, None], len(codes), axis=1)
        square = np.full(len(codes), centre @ centre)
        for k, (p, b) in enumerate(zip(self.parts, self.books, strict=True)):
            dots += (vectors[:, p] @ b.T)[:, codes[:, k]]
            square += (2 * b @ centre[p] + np.einsum("ij,ij->i", b, b))[codes[:, k]]
        return np.sqrt(np.maximum(np.einsum("ij,ij->i", vectors, vectors)[:, None] + square[None, :] - 2 * dots, 0))


def _unit(wide: np.ndarray) -> np.ndarray:
    """Rows of length 1. The largest component is divided out first, so no square underflows or overflows."""
    wide = wide.astype(np.float64)
    wide = wide / np.abs(wide).max(axis=1, keepdims=True)
    return wide / np.linalg.norm(wide, axis=1, keepdims=True)


def classes(vectors: DataFrame, id_col: str, embedding_col: str, label_col: str) -> DataFrame:
    """(node, rep, copies, label, vec): the distinct usable vectors of each label, a number, the smallest id and the number of their rows."""
    finite = F.forall(embedding_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.col(label_col).isNotNull() & F.col(embedding_col).isNotNull() & finite & F.exists(embedding_col, lambda x: x != 0)
    kept = vectors.where(F.coalesce(usable, F.lit(False)))
    found = kept.groupBy(F.col(label_col).cast("string").alias("label"), F.col(embedding_col).alias("vec")).agg(F.min(F.col(id_col).cast("long")).alias("rep"), F.count("*").alias("copies"))
    return materialize(found.withColumn("node", F.monotonically_increasing_id()), "pq-classes")


def fit(distinct: DataFrame) -> dict[int, Quantiser]:
    """Quantisers by vector length, fitted on at most SAMPLE vectors each, chosen by a hash; cells grow with the largest label."""
    sizes = distinct.groupBy(F.size("vec").alias("dim"), "label").agg(F.count("*").alias("n")).groupBy("dim").agg(F.sum("n").alias("n"), F.max("n").alias("largest"))
    out = {}
    for r in sizes.orderBy(F.desc("n"), "dim").limit(MAX_DIMS).collect():
        most = max(1, min(SAMPLE, SAMPLE_VALUES // r["dim"]))
        share = min(1.0, most / r["n"])
        rows = distinct.where((F.size("vec") == r["dim"]) & (F.pmod(F.xxhash64("vec"), F.lit(1 << 30)) < int(share * (1 << 30)))).select("vec").limit(most).toPandas()
        if len(rows):
            out[r["dim"]] = Quantiser(_unit(np.stack(rows["vec"].to_numpy())), max(1, round(r["largest"] / LIST_SIZE)))
    return out


_ROW = "label string, dim int, cell int, member boolean, node long, copies long, code binary, off double, vec array<{}>"


def _lists(shared, least: float, reach: float | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted: dict[int, Quantiser] = shared.value
        for batch in batches:
            dims = np.array(pa.compute.list_value_length(batch.column("vec")))
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim))
                border = (min(1.0, DEVIATIONS / dim**0.5) if reach is None else reach) * np.sqrt(max(0.0, 2 - 2 * least))
                for start in range(0, part.num_rows, 2048):
                    piece = part.slice(start, 2048)
                    n = piece.num_rows
                    if dim in fitted:
                        unit = _unit(np.asarray(piece.column("vec").flatten()).reshape(n, dim))
                        cell, codes, off = fitted[dim].encode(unit)
                        probes = fitted[dim].probes(unit, cell, border)
                    else:
                        cell, codes, off, probes = np.zeros(n, np.int64), np.zeros((n, 0), np.uint8), np.zeros(n), [np.zeros(0, np.int64)] * n
                    many = np.array([len(p) for p in probes])
                    row = np.concatenate([np.arange(n), np.repeat(np.arange(n), many)])
                    at = np.concatenate([cell, *probes])
                    take = pa.array(row)
                    coded = pa.array([c.tobytes() for c in codes], pa.binary())
                    columns = [piece.column("label"), pa.array(np.full(n, dim, np.int32)), None, None, piece.column("node"), piece.column("copies"), coded, pa.array(off), piece.column("vec")]
                    columns = [c if c is None else c.take(take) for c in columns]
                    columns[2], columns[3] = pa.array(at.astype(np.int32)), pa.array(np.arange(len(row)) < n)
                    yield pa.record_batch(columns, names=["label", "dim", "cell", "member", "node", "copies", "code", "off", "vec"])

    return run


def _forest(adjacent: np.ndarray) -> list[tuple[int, int]]:
    left, out = np.ones(len(adjacent), bool), []
    for root in range(len(adjacent)):
        if not left[root]:
            continue
        left[root] = False
        todo = [root]
        while todo:
            one = todo.pop()
            new = np.flatnonzero(adjacent[one] & left)
            left[new] = False
            out += [(one, int(k)) for k in new]
            todo.extend(new.tolist())
    return out


def _compare(shared, least: float):
    farthest = np.sqrt(max(0.0, 2 - 2 * least)) + 1e-9

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        """One block of a list: rows of chunk `i` against rows of chunk `j`, or chunk `i` against itself."""
        fitted: dict[int, Quantiser] = shared.value
        first = rows.iloc[0]
        unit = _unit(np.stack(rows["vec"].to_numpy()))
        member, own, copies = rows["member"].to_numpy(), rows["chunk"].to_numpy(), rows["copies"].to_numpy()
        n = len(rows)
        ok = np.triu(np.ones((n, n), bool), 1) & (member[:, None] | member[None, :])
        if first["i"] != first["j"]:
            ok &= own[:, None] != own[None, :]
        quantiser = fitted.get(int(first["dim"]))
        if quantiser is not None and n > 1:
            # a member is decoded from its codes; what its decoding is off by is added to the limit
            m = np.flatnonzero(member)
            codes = np.frombuffer(b"".join(rows["code"].iloc[m]), np.uint8).reshape(len(m), len(quantiser.parts))
            near = np.zeros((n, n), bool)
            near[:, m] = quantiser.asymmetric(unit, int(first["cell"]), codes) <= farthest + rows["off"].to_numpy()[m][None, :]
            ok &= near | near.T
        a, b = np.nonzero(ok)
        linked = np.zeros((n, n), bool)
        for start in range(0, len(a), 1 << 18):
            x, y = a[start : start + (1 << 18)], b[start : start + (1 << 18)]
            good = np.einsum("ij,ij->i", unit[x], unit[y]) >= least
            linked[x[good], y[good]] = linked[y[good], x[good]] = True
        node = rows["node"].to_numpy()
        edges = _forest(linked)
        counts = linked @ copies
        seen = np.flatnonzero(counts)
        return pd.DataFrame(
            {
                "a": np.concatenate([node[seen], node[[x for x, _ in edges]]]).astype(np.int64) if len(seen) else np.zeros(0, np.int64),
                "b": np.concatenate([node[seen], node[[y for _, y in edges]]]).astype(np.int64) if len(seen) else np.zeros(0, np.int64),
                "n": np.concatenate([counts[seen], np.zeros(len(edges), np.int64)]).astype(np.int64) if len(seen) else np.zeros(0, np.int64),
            }
        )

    return run


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", embedding_col: str = "embedding", label_col: str = "label", least: float = LEAST_COSINE, reach: float | None = None) -> DataFrame:
    """One row per input row: vec_id, n_links, component_id (smallest vec_id reachable by links), kept.

    Vectors link if their labels are equal and their cosine is at least `least`.
    Null labels, null, zero and empty vectors, and vectors with null or
    non-finite components link with nothing; very small and very large ones link
    like any other. Equal vectors of a label are one class, so a group of copies
    is compared once. Rows with the same vec_id are kept and linked by their own
    vectors; a null vec_id is no smallest one. A list that is longer than BLOCK
    is cut in chunks, and every two chunks meet in a task of their own.
    """
    spark = vectors.sparkSession
    distinct = classes(vectors, id_col, embedding_col, label_col)
    shared = spark.sparkContext.broadcast(fit(distinct))
    kind = vectors.schema[embedding_col].dataType.elementType.simpleString()
    lists = materialize(distinct.drop("rep").mapInArrow(_lists(shared, least, reach), _ROW.format(kind)), "pq-lists")
    sizes = lists.groupBy("label", "dim", "cell").agg(F.count("*").alias("n"), F.max(F.col("member").cast("int")).alias("any"))
    # only what is cut needs its size; the others go to their task as they are
    long = materialize(sizes.where(f"any = 1 and n > {BLOCK}").select("label", "dim", "cell", F.ceil(F.col("n") / BLOCK).cast("int").alias("chunks")), "pq-sizes")
    cut = lists.join(long, ["label", "dim", "cell"], "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    cut = cut.withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks").cast("long")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other")
    tasks = cut.select("*", other).withColumn("i", F.least("chunk", "other")).withColumn("j", F.greatest("chunk", "other"))
    found = tasks.groupBy("label", "dim", "cell", "i", "j").applyInPandas(_compare(shared, least), "a long, b long, n long")
    found = materialize(found, "pq-links")
    links = found.where("a = b").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("links"))
    groups = connected_components(found.where("a <> b").select("a", "b"), "pq")
    named = distinct.join(links, "node", "left").join(groups, "node", "left")
    named = materialize(named.select("label", "vec", "rep", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component")), "pq-named")
    least_id = materialize(named.groupBy("component").agg(F.min("rep").alias("component_id")), "pq-least")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(embedding_col).alias("vec"))
    joined = rows.join(named.join(least_id, "component"), ["label", "vec"], "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return joined.withColumn("kept", F.col("vec_id") == F.col("component_id"))
