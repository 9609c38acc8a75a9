"""Benchmark decontamination: an FM-index per training shard, searched backwards for the benchmark's windows."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, Words, lowered, materialize, text_buffer, text_slices
from .fm_index import FMIndex

WINDOW = 13
#: A shard's index closes at so many symbols, or so many documents.
SHARD_SYMBOLS, SHARD_DOCS = 1 << 21, 1 << 17
#: Windows that are searched at once, in bytes of their text; more are searched in further passes over the indexes.
BLOCK_BYTES = 16 << 20
#: Leading bits of a word's hash that tell whether any window may hold the word: a bit map of 2**22 bits for every benchmark.
KNOWN_BITS = 22

_INDEX = "shard long, ids array<long>, hashes array<long>, n_words array<long>, index binary"
_FOUND = "shard long, row int, spans array<struct<start:long,end:long>>, windows array<long>"


def item_windows(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item, window): the distinct runs of WINDOW words of each item, or all its words if fewer; words joined by a space."""
    words = F.expr(r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', 0)")
    split = items.select(F.col(id_col).cast("string").alias("item"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).select("item", words.alias("w"))
    starts = F.expr(f"sequence(1, greatest(size(w) - {WINDOW} + 1, 1))")
    return (
        split.where(F.size("w") > 0)
        .select("item", F.explode(F.transform(starts, lambda i: F.array_join(F.slice("w", i, WINDOW), " "))).alias("window"))
        .distinct()
    )


def _word_hashes(texts: pa.Array) -> tuple[Words, np.ndarray]:
    raw, offsets = text_buffer(texts)
    words = Words(lowered(raw), offsets, ALNUM)
    return words, words.hashes()


def _known_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The leading bits of all words of the windows."""
    for part in text_slices(batches, "window"):
        yield pa.record_batch([pa.array(np.unique(_word_hashes(part.column("window"))[1] >> np.uint64(64 - KNOWN_BITS)).astype(np.int64))], names=["lead"])


class Shard:
    """Documents of a task. Words that no window can hold end a run; runs shorter than every window are left out."""

    def __init__(self, known: np.ndarray, shortest: int):
        self.known, self.shortest = known, shortest
        self.ids: list[pa.Array] = []
        self.hashes: list[pa.Array] = []
        self.n_words: list[np.ndarray] = []
        self.runs: list[tuple[np.ndarray, ...]] = []
        self.docs = self.size = 0

    def add(self, ids: pa.Array, hashes: pa.Array, texts: pa.Array) -> None:
        words, symbols = _word_hashes(texts)
        counts = np.diff(words.row)
        inside = np.zeros(len(symbols) + 2, np.int8)
        inside[1:-1] = self.known[(symbols >> np.uint64(64 - KNOWN_BITS)).astype(np.int64)]
        edge = np.diff(inside)
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        cuts = np.unique(words.row[1:-1])
        cuts = cuts[(cuts > 0) & (cuts < len(symbols))]
        cuts = cuts[(inside[cuts] == 1) & (inside[cuts + 1] == 1)]
        start, end = np.sort(np.concatenate([start, cuts])), np.sort(np.concatenate([end, cuts]))
        kept = end - start >= self.shortest
        start, length = start[kept], (end - start)[kept]
        doc = np.searchsorted(words.row, start, side="right") - 1
        at = np.repeat(start - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))
        self.runs.append((symbols[at], length, doc + self.docs, start - words.row[doc]))
        self.ids.append(ids)
        self.hashes.append(hashes)
        self.n_words.append(counts)
        self.docs += len(counts)
        self.size += len(at)

    def record(self, number: int) -> pa.RecordBatch:
        """The shard's documents and its index: alphabet, FM-index of the runs, their lengths, documents and first words."""
        symbols, length, doc, first = (np.concatenate(x) for x in zip(*self.runs, strict=True))
        index = None
        if len(symbols):
            alphabet, coded = np.unique(symbols, return_inverse=True)
            text = np.zeros(len(symbols) + len(length), np.int64)  # a 0 ends each run
            text[np.arange(len(symbols)) + np.repeat(np.arange(len(length)), length)] = coded + 1
            index = pickle.dumps((alphabet, FMIndex(text, len(alphabet)), length, doc, first))
        lists = [pa.array([x], pa.list_(pa.int64())) for x in (pa.concat_arrays(self.ids), pa.concat_arrays(self.hashes), np.concatenate(self.n_words).astype(np.int64))]
        return pa.record_batch([pa.array([number]), *lists, pa.array([index], pa.binary())], names=["shard", "ids", "hashes", "n_words", "index"])


def build_indexes(docs: DataFrame, windows: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A stored table of FM-indexes, one row a shard, in which any block of `windows` (window) can be searched.

    Only runs of words that may occur in a window are indexed, which loses no
    occurrence. What is sent to the tasks for that is a bit map of fixed size.
    """
    known = np.zeros(1 << KNOWN_BITS, bool)
    leads = windows.select("window").mapInArrow(_known_words, "lead long").distinct()
    known[leads.toPandas()["lead"].to_numpy()] = True
    shortest = windows.agg(F.min(F.size(F.split("window", " "))).alias("n")).first()["n"] or WINDOW
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(known))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.unpackbits(shared.value).astype(bool)
        number = TaskContext.get().partitionId() << 32
        shard = Shard(held, shortest)
        for part in text_slices(batches, "text"):
            shard.add(part.column("doc_id"), part.column("hash"), part.column("text"))
            if shard.size >= SHARD_SYMBOLS or shard.docs >= SHARD_DOCS:
                yield shard.record(number)
                number, shard = number + 1, Shard(held, shortest)
        if shard.docs:
            yield shard.record(number)

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("hash"), F.col(text_col).alias("text"))
    return materialize(texts.mapInArrow(run, _INDEX), "fm-indexes")


class Phrases:
    """A block of windows: the hashes of their words, padded, their lengths and keys."""

    def __init__(self, windows: list[str], keys: list[int]):
        words, hashes = _word_hashes(pa.array(windows, pa.string()))
        self.keys = np.array(keys, np.int64)
        self.lengths = np.diff(words.row)
        self.patterns = np.zeros((len(windows), int(self.lengths.max())), np.uint64)
        self.patterns[np.arange(self.patterns.shape[1])[None, :] < self.lengths[:, None]] = hashes


def _search(phrases: Phrases):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, held in zip(batch.column("shard").to_pylist(), batch.column("index"), strict=True):
                if not held.is_valid:
                    continue
                alphabet, index, length, doc, first = pickle.loads(held.as_py())
                coded = np.minimum(np.searchsorted(alphabet, phrases.patterns), len(alphabet) - 1)
                missing = (alphabet[coded] != phrases.patterns) & (np.arange(coded.shape[1])[None, :] < phrases.lengths[:, None])
                there = np.flatnonzero(~missing.any(axis=1))
                lengths = phrases.lengths[there]
                low, high = index.search(coded[there] + 1, lengths)
                hits = np.flatnonzero(high > low)
                if not len(hits):
                    continue
                n = (high - low)[hits]
                which = np.repeat(hits, n)
                place = index.locate(np.repeat(low[hits] - (np.cumsum(n) - n), n) + np.arange(int(n.sum())))
                ends = np.cumsum(length + 1)
                # removal spans: the union of all occurrences, run by run
                cover = np.zeros(int(ends[-1]) + 1, np.int64)
                np.add.at(cover, place, 1)
                np.add.at(cover, place + lengths[which], -1)
                edge = np.diff(np.concatenate([[0], (np.cumsum(cover) > 0).astype(np.int8)]))
                s, e = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
                run_ = np.searchsorted(ends, s, side="right")
                at = first[run_] - (ends - length - 1)[run_]
                pairs = np.unique(np.stack([doc[np.searchsorted(ends, place, side="right")], there[which]], axis=1), axis=0)
                rows, starts = np.unique(pairs[:, 0], return_index=True)
                spans = pa.StructArray.from_arrays([pa.array(s + at), pa.array(e + at)], ["start", "end"])
                lists = [
                    pa.ListArray.from_arrays(pa.array(np.append(np.searchsorted(doc[run_], rows), len(s)), pa.int32()), spans),
                    pa.ListArray.from_arrays(pa.array(np.append(starts, len(pairs)), pa.int32()), pa.array(phrases.keys[pairs[:, 1]])),
                ]
                yield pa.record_batch([pa.array([number] * len(rows), pa.int64()), pa.array(rows, pa.int32()), *lists], names=["shard", "row", "spans", "windows"])

    return run


#: Sorted spans, joined where they overlap or touch.
_UNION = """aggregate(array_sort(s), cast(array() as array<struct<start:bigint,end:bigint>>), (acc, x) ->
    if(size(acc) > 0 and element_at(acc, -1).end >= x.start,
       concat(slice(acc, 1, size(acc) - 1), array(named_struct('start', element_at(acc, -1).start, 'end', greatest(element_at(acc, -1).end, x.end)))),
       concat(acc, array(x))))"""


def contamination(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: doc_id, text_hash (xxhash64), n_words, spans (word positions covered by benchmark windows, merged), items.

    The documents are indexed once. The windows are searched in blocks of about
    `block_bytes`, so what is sent to the tasks is bounded however large the
    benchmark is; what they find is put together by shard and row, so documents
    without an id or with the same one are each judged by their own text. Items
    are joined to the windows found, so a window may belong to any number of
    them. Null texts have no words; null or empty items have no window. Texts are
    handled whole; a task needs about 25 times the bytes of its longest one.
    """
    pairs = materialize(item_windows(items, item_id, item_text).withColumn("key", F.xxhash64("window")), "fm-windows")
    indexes = build_indexes(docs, pairs, doc_id, doc_text)
    size = pairs.agg(F.sum(F.octet_length("window")).alias("n")).first()["n"] or 0
    blocks = -(-int(size) // block_bytes)
    found = []
    for block in range(blocks):
        rows = pairs.where(F.pmod("key", F.lit(blocks)) == block).groupBy("key").agg(F.min("window").alias("window")).collect()
        if rows:
            found.append(indexes.select("shard", "index").mapInArrow(_search(Phrases([r["window"] for r in rows], [r["key"] for r in rows])), _FOUND))
    listed = indexes.select("shard", F.posexplode(F.arrays_zip("ids", "hashes", "n_words")).alias("row", "d"))
    listed = listed.select("shard", "row", F.col("d.ids").alias("doc_id"), F.col("d.hashes").alias("text_hash"), F.col("d.n_words").alias("n_words"))
    none, no_item = F.array().cast("array<struct<start:bigint,end:bigint>>"), F.array().cast("array<string>")
    if not found:
        return listed.select("doc_id", "text_hash", "n_words", none.alias("spans"), no_item.alias("items"))
    hits = materialize(reduce(DataFrame.unionByName, found), "fm-hits")
    spans = hits.groupBy("shard", "row").agg(F.flatten(F.collect_list("spans")).alias("s")).select("shard", "row", F.expr(_UNION).alias("spans"))
    named = hits.select("shard", "row", F.explode("windows").alias("key")).join(pairs.select("key", "item"), "key")
    named = named.groupBy("shard", "row").agg(F.sort_array(F.collect_set("item")).alias("items"))
    judged = materialize(spans.join(named, ["shard", "row"]), "fm-judged")
    return listed.join(judged, ["shard", "row"], "left").select("doc_id", "text_hash", "n_words", F.coalesce("spans", none).alias("spans"), F.coalesce("items", no_item).alias("items"))


def is_contaminated(n_hit, n_words):
    """The rule: at least a twentieth of the words lie in benchmark windows."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def hit_words():
    return F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])
