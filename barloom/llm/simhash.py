"""SimHash near-duplicates through an inverted index on byte positions with count filtering."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, text_slices
from .components import connected_components

#: Two fingerprints that differ in at most `MAX_BITS` bits share at least `8 - MAX_BITS` of their 8 bytes.
MAX_BITS = 3
SHARED_BYTES = 8 - MAX_BITS
_CHUNK = 1 << 16


def fingerprint(text: bytes, width: int = 3) -> int:
    """64-bit SimHash of the `width`-word shingles (XXH64, seed 42) of a UTF-8 text; no word gives zero."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < width:
        shingles: Iterator[bytes] = iter([b" ".join(words)])
        n = 1
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
        n = len(words) - width + 1
    digest = xxhash.xxh64_intdigest
    bits = np.zeros(64, np.int64)
    for done in range(0, n, _CHUNK):
        take = min(_CHUNK, n - done)
        h = np.fromiter((digest(next(shingles), 42) for _ in range(take)), np.uint64, take)
        bits += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, fp) for each row: fp holds the 64 bits in a long. Null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "text"):
            texts = part.column("text").cast(pa.binary()).to_pylist()
            fps = np.array([fingerprint(t or b"") for t in texts], np.uint64).view(np.int64)
            yield pa.record_batch([part.column("doc_id"), part.column("text_hash"), pa.array(fps)], names=["doc_id", "text_hash", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_hash"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, text_hash long, fp long")


def position_sets() -> list[tuple[int, ...]]:
    """Fourteen sets of four byte positions such that any five of the eight positions contain one of them.

    The two halves, and a pair of each half from pairings that go together: five
    positions of which three lie in one half hold a pair of each of its three
    pairings, one of them with the pair in the other half.
    """
    pairings = [((0, 1), (2, 3)), ((0, 2), (1, 3)), ((0, 3), (1, 2))]
    mixed = [(*one, *(4 + k for k in two)) for pairs in pairings for one in pairs for two in pairs]
    return [(0, 1, 2, 3), (4, 5, 6, 7), *mixed]


def _mask(positions: tuple[int, ...]) -> int:
    return sum(0xFF << (8 * p) for p in positions)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


_LOW = np.uint64(0x0101010101010101)


def _matches(one: np.uint64, others: np.ndarray) -> np.ndarray:
    """Count filter on shared positional bytes, then the exact check on bits."""
    x = others ^ one
    y = x | (x >> np.uint64(4))
    y = y | (y >> np.uint64(2))
    y = y | (y >> np.uint64(1))
    tally = 8 - np.bitwise_count(y & _LOW).astype(np.int8)
    kept = np.flatnonzero(tally >= SHARED_BYTES)
    return kept[np.bitwise_count(x[kept]) <= MAX_BITS]


def spanning_forest(fps: np.ndarray, limit: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """Edges (i, j) that join the same members of a posting list as all its matching pairs would.

    A search from member to member compares each only with those not yet
    reached. A list over `limit` is cut first: if all its members agree in k
    positions, a matching pair agrees in 5 - k of the others, so it meets in one
    of the parts that those positions make. A part over `limit` that agrees in
    five positions looks up each member's neighbours in place of comparing.
    """
    if len(fps) <= limit:
        return _search(fps)
    differ = int(np.bitwise_or.reduce(fps ^ fps[0]))
    free = [p for p in range(8) if differ >> (8 * p) & 0xFF]
    more = SHARED_BYTES - (8 - len(free))
    if more <= 0:
        return _look_up(fps, differ)
    found = []
    for positions in combinations(free, more):
        key = fps & np.uint64(_mask(positions))
        order = np.argsort(key, kind="stable")
        parts = np.split(order, np.flatnonzero(np.diff(key[order])) + 1)
        found += [(x, *spanning_forest(fps[x], limit)) for x in parts if len(x) > 1]
    if found:
        return np.concatenate([x[i] for x, i, _ in found]), np.concatenate([x[j] for x, _, j in found])
    return np.zeros(0, np.int64), np.zeros(0, np.int64)


def _look_up(fps: np.ndarray, differ: int) -> tuple[np.ndarray, np.ndarray]:
    """The same for members that differ in at most three bytes: each flip of up to MAX_BITS of the differing bits is looked up.

    2,324 flips at most, so the time grows with the members and not with their
    pairs. What is found is folded into one label a member.
    """
    order = np.argsort(fps)
    ordered, root = fps[order], np.arange(len(fps))
    bits = [b for b in range(64) if differ >> b & 1]
    for n in range(1, MAX_BITS + 1):
        for flip in combinations(bits, n):
            other = ordered ^ np.uint64(sum(1 << b for b in flip))
            at = np.minimum(np.searchsorted(ordered, other), len(ordered) - 1)
            one = np.flatnonzero((ordered[at] == other) & (root != root[at]))
            while len(one):  # hook the larger root under the smaller and follow to the roots
                a, b = root[one], root[at[one]]
                np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
                while (root[root] != root).any():
                    root = root[root]
                one = one[root[one] != root[at[one]]]
    member = np.flatnonzero(root != np.arange(len(root)))
    return order[member], order[root[member]]


def _search(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    left, a, b = np.arange(len(fps)), [], []
    while len(left):
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            one = todo.pop()
            hit = _matches(fps[one], fps[left])
            if len(hit):
                new = left[hit]
                left = np.delete(left, hit)
                a.append(np.full(len(new), one))
                b.append(new)
                todo.extend(new.tolist())
    if not a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(a), np.concatenate(b)


def _list_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (part, key): each run is a posting list, which may go on over many batches."""
    held: list[tuple[np.ndarray, ...]] = []
    for batch in _with_end(batches):
        if batch is not None:
            cols = tuple(batch.column(k).to_numpy() for k in range(3))
            change = np.flatnonzero((cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])) + 1
            goes_on = held and held[-1][0][-1] == cols[0][0] and held[-1][1][-1] == cols[1][0]
            if goes_on and not len(change):
                held.append(cols)
                continue
            # the last list may go on in the next batch
            last = int(change[-1]) if len(change) else 0
            done, held = [*held, tuple(c[:last] for c in cols)], [tuple(c[last:] for c in cols)]
        else:
            done = held
        if not done:
            continue
        part, key, fp = (np.concatenate(c) for c in zip(*done, strict=True))
        edge = np.concatenate([[0], np.flatnonzero((part[1:] != part[:-1]) | (key[1:] != key[:-1])) + 1, [len(part)]])
        a, b = [], []
        for k in np.flatnonzero(np.diff(edge) > 1):
            s, e = edge[k], edge[k + 1]
            i, j = spanning_forest(fp[s:e].view(np.uint64))
            a.append(fp[s:e][i])
            b.append(fp[s:e][j])
        if a:
            yield pa.record_batch([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    for batch in batches:
        if batch.num_rows:
            yield batch
    yield None


def links(nodes: DataFrame) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs of the distinct fingerprints `nodes` (fp) within MAX_BITS bits.

    A posting list for one byte at one position would hold a 256th of all
    fingerprints, and the pairs in it would grow with the square of the corpus.
    So the index takes sets of four positions, 32 bits: any five shared bytes
    contain one of the fourteen sets, so no pair that reaches the count is
    missed. In its list a pair's shared bytes are counted, pairs under five are
    dropped, and the rest are verified by their bits. A list comes to one task,
    16 bytes for each of its different fingerprints.
    """
    keys = [F.struct(F.lit(k).alias("part"), F.col("fp").bitwiseAND(F.lit(_signed(_mask(c)))).alias("key")) for k, c in enumerate(position_sets())]
    rows = nodes.select(F.explode(F.array(*keys)).alias("p"), "fp").select("p.part", "p.key", "fp")
    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(n, "part", "key").sortWithinPartitions("part", "key", "fp")
    return rows.mapInArrow(_list_edges, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, text_hash (xxhash64), fp (long), component_id (smallest doc_id reachable by links of at most 3 bits), kept.

    Of each component the text with the smallest doc_id is kept; of several texts
    with that id (or without any id), the one with the smallest hash.

    Null and empty texts have fingerprint zero and link like any other; equal
    fingerprints are one node, so groups of copies cost one index entry; rows
    with the same doc_id are kept and linked by their own texts; a null doc_id is
    no smallest one, and is null itself only in a component without ids; an
    empty table gives an empty result. Texts are handled whole; a task needs
    about 30 times the bytes of its longest one.
    """
    marked = materialize(fingerprints(docs, id_col, text_col), "simhash-fp")
    first = F.struct(F.isnull("doc_id").alias("unnamed"), "doc_id", "text_hash")  # missing ids come last
    nodes = materialize(marked.groupBy("fp").agg(F.min(first).alias("least")), "simhash-nodes")
    groups = connected_components(links(nodes.select("fp")), "simhash")
    named = materialize(nodes.join(groups.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component")), "simhash-named")
    least = named.groupBy("component").agg(F.min("least").alias("least"))
    by_fp = materialize(named.select("fp", "component").join(least, "component").select("fp", "least"), "simhash-classes")
    kept = F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("text_hash") == F.col("least.text_hash"))
    return marked.join(by_fp, "fp").select("doc_id", "text_hash", "fp", F.col("least.doc_id").alias("component_id"), kept.alias("kept"))
