"""Substring dedup on a log-structured index of window fingerprints."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACED, Words, materialize, range_hash, scratch, shuffles_dropped, text_buffer, text_slices

WINDOW = 13
#: Rows of a record batch.
ROWS = 1 << 16
#: A window's fingerprint is the least hash of its runs of GRAM words. Neighbouring
#: windows share it, so the index holds about two entries for nine words.
GRAM = 6
#: Runs of the index that may stand side by side; with more, the newest two are merged.
FAN_IN = 2
#: The filter over repeated fingerprints has 10 bits for each, and this many bytes at most.
FILTER_BYTES = 32 << 20
#: Windows are verified in so many rounds, each with the fingerprints of its remainder and a filter of its own.
#: Twice as many rounds halve what is on disk at once, and hash the texts twice as often.
ROUNDS = 2


def _fingerprints(raw: np.ndarray, offsets: np.ndarray) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words, their hashes, and for each window of each text: text, first word, fingerprint."""
    words = Words(raw, offsets, SPACED)
    h = words.hashes()
    counts = np.diff(words.row)
    windows = np.maximum(counts - WINDOW + 1, 0)
    text = np.repeat(np.arange(len(counts)), windows)
    first = np.arange(int(windows.sum())) - np.repeat(np.cumsum(windows) - windows, windows) + words.row[text]
    if not len(first):
        return words, h, text, first, np.zeros(0, np.uint64)
    at = np.arange(len(h) - GRAM + 1)
    least = range_hash(h, at, at + GRAM)
    left, span = WINDOW - GRAM + 1, 1
    while span < left:  # the least of `left` neighbours, by doubling
        step = min(span, left - span)
        least = np.minimum(least[:-step], least[step:])
        span += step
    return words, h, text, first, least[first]


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in text_slices(batches, "text"):
        _, _, text, _, print_ = _fingerprints(*text_buffer(part.column("text")))
        if len(text):
            new = np.concatenate([[True], (print_[1:] != print_[:-1]) | (text[1:] != text[:-1])])
            docs = part.column("doc_id").take(pa.array(text[new]))
            yield pa.record_batch([pa.array(print_[new].view(np.int64)), docs], names=["print", "doc_id"])


class FingerprintIndex:
    """Sorted immutable runs (print, first_doc) of all documents taken in, one for each batch until runs are merged.

    A run is a table bucketed by fingerprint and sorted within its buckets, so a
    batch is shuffled to the buckets and merge-joined with each run, and history
    is never shuffled again. Runs are not changed: when more than FAN_IN stand
    side by side, the newest two are merge-joined into a new one and dropped.

    The tables are those of a database in the folder `path`; `runs` lists the
    live ones with their number of buckets, so an index is opened again, in any
    session, with its path and that list. The texts are not copied: what a later
    batch repeats is verified on the texts of the documents taken in before.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, runs: list[tuple[str, int]] | None = None):
        self.spark, self.path, self.runs = spark, path or scratch(spark, "prints"), list(runs or [])
        self.name = "prints_" + hashlib.md5(self.path.encode()).hexdigest()[:16]
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {self.name} LOCATION '{self.path}'")
        for run, buckets in self.runs:
            columns = "print BIGINT, first_doc BIGINT, old BOOLEAN, repeated BOOLEAN"
            spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name}.{run} ({columns}) USING parquet CLUSTERED BY (print) SORTED BY (print) INTO {buckets} BUCKETS LOCATION '{self.path}/{run}'")

    def _read(self, run: str) -> DataFrame:
        return self.spark.table(f"{self.name}.{run}")

    def _write(self, rows: DataFrame) -> str:
        run = f"run_{uuid.uuid4().hex}"
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        with shuffles_dropped(self.spark):
            rows.write.bucketBy(buckets, "print").sortBy("print").option("compression", "zstd").saveAsTable(f"{self.name}.{run}")
        self.runs.append((run, buckets))
        return run

    def ingest(self, docs: DataFrame) -> DataFrame:
        """Take in a batch (doc_id, text); give the fingerprints (print) that it repeats, from itself or from the runs.

        The new run lists all of the batch's fingerprints and marks those that an
        older run holds too. Copies are minima and maxima before they are shuffled.
        """
        entries = docs.mapInArrow(_entries, "print long, doc_id long")
        fresh = entries.groupBy("print").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))
        seen = [F.lit(None).cast("long")]
        for k, (run, _) in enumerate(self.runs):
            fresh = fresh.join(self._read(run).select("print", F.col("first_doc").alias(f"run_{k}")).hint("merge"), "print", "left")
            seen.append(F.col(f"run_{k}"))
        earliest = F.least(F.col("first_doc"), *seen)
        known = F.coalesce(*seen).isNotNull()
        # a fingerprint of history counts even where this batch has it in one document only, with a smaller id
        repeated = (earliest < F.col("last_doc")) | (known & (F.greatest(*seen, F.col("last_doc")) > earliest))
        run = self._write(fresh.select("print", earliest.alias("first_doc"), known.alias("old"), F.coalesce(repeated, F.lit(False)).alias("repeated")))
        found = materialize(self._read(run).where("repeated").select("print"), "prints-repeated")
        self.compact()
        return found

    def compact(self) -> None:
        """Merge the newest two runs, the smallest doc_id of each fingerprint, until at most FAN_IN are left."""
        while len(self.runs) > FAN_IN:
            (one, _), (two, _) = self.runs[-2:]
            newer = self._read(two).select("print", F.col("first_doc").alias("newer"))
            merged = self._read(one).select("print", "first_doc").join(newer.hint("merge"), "print", "full")
            self._write(merged.select("print", F.least("first_doc", "newer").alias("first_doc"), F.lit(False).alias("old"), F.lit(False).alias("repeated")))
            del self.runs[-3:-1]
            for run in (one, two):
                self.spark.sql(f"DROP TABLE {self.name}.{run}")


class Filter:
    """A Bloom filter of bounded size, in blocks that separate tasks make."""

    BLOCKS, HASHES = 64, 4

    def __init__(self, bits: np.ndarray):
        self.bits = bits
        self.size = bits.shape[1] * 8

    @staticmethod
    def block(prints: np.ndarray) -> np.ndarray:
        return (prints >> np.uint64(58)).astype(np.int64)

    @staticmethod
    def places(prints: np.ndarray, size: int) -> list[np.ndarray]:
        h = prints * np.uint64(0x9E3779B97F4A7C15)
        low, step = h >> np.uint64(32), (prints ^ (prints >> np.uint64(29))) & np.uint64(0xFFFFFFFF) | np.uint64(1)
        return [((low + np.uint64(k) * step) % np.uint64(size)).astype(np.int64) for k in range(Filter.HASHES)]

    @classmethod
    def build(cls, prints: DataFrame) -> Filter:
        block = max(64, min(FILTER_BYTES, prints.count() * 10 // 8) // cls.BLOCKS)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            made: dict[int, np.ndarray] = {}
            for batch in batches:
                mine = batch.column("print").to_numpy().view(np.uint64)
                of = cls.block(mine)
                for b in np.unique(of).tolist():
                    bits = made.setdefault(b, np.zeros(block * 8, bool))
                    for p in cls.places(mine[of == b], block * 8):
                        bits[p] = True
            for b, bits in made.items():
                yield pa.record_batch([pa.array([b]), pa.array([np.packbits(bits, bitorder="little").tobytes()])], names=["block", "bits"])

        # a block comes to one task, so each of its bytes reaches the driver once
        dealt = prints.select("print", F.shiftrightunsigned("print", 58).alias("block"))
        out = np.zeros((cls.BLOCKS, block), np.uint8)
        for r in dealt.repartition(cls.BLOCKS, "block").select("print").mapInArrow(run, "block long, bits binary").collect():
            out[r["block"]] = np.frombuffer(r["bits"], np.uint8)
        return cls(out)

    def holds(self, prints: np.ndarray) -> np.ndarray:
        blocks = self.block(prints)
        out = np.ones(len(prints), bool)
        for p in self.places(prints, self.size):
            out &= (self.bits[blocks, p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1
        return out


def _candidates(shared, round_: int, keyed: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repeated: Filter = shared.value
        for part in text_slices(batches, "text"):
            words, h, text, first, print_ = _fingerprints(*text_buffer(part.column("text")))
            hit = np.flatnonzero(print_ % np.uint64(ROUNDS) == round_)
            hit = hit[repeated.holds(print_[hit])]
            text, first = text[hit], first[hit]
            one = range_hash(h, first, first + WINDOW).view(np.int64)
            two = (range_hash(h, first, first + WINDOW, second=True) >> np.uint64(32)).astype(np.uint32).view(np.int32)
            at = (first - words.row[text]).astype(np.int32)
            for k in range(0, len(hit), ROWS):
                docs = part.column("doc_id").take(pa.array(text[k : k + ROWS]))
                columns = {"h1": pa.array(one[k : k + ROWS]), "h2": pa.array(two[k : k + ROWS]), "doc_id": docs}
                if keyed:
                    columns |= {"text_hash": part.column("text_hash").take(pa.array(text[k : k + ROWS])), "at": pa.array(at[k : k + ROWS])}
                yield pa.RecordBatch.from_pydict(columns)

    return run


def repeated_windows(docs: DataFrame, index: FingerprintIndex | None = None, history: DataFrame | None = None, batches: int = 3) -> DataFrame:
    """(doc_id, text_hash, at): every window (first word `at`) whose words also start a window of a document with a smaller doc_id.

    A document is named by its doc_id and the hash of its text (`text_hash`,
    beside doc_id and text in `docs`), as different texts may share an id.

    The documents go through the index in batches of ascending doc_id. What the
    index reports is verified on whole windows: those whose fingerprint may be
    repeated, of these documents and of `history` (doc_id, text; all that the
    index took in before), are hashed with 96 bits and compared with the smallest
    doc_id that has them. The filter only saves shuffling: a false hit is dropped
    there, and with a full filter all windows of a round are shuffled.
    """
    spark = docs.sparkSession
    index = index or FingerprintIndex(spark)
    if index.runs and history is None:
        raise ValueError("an index that holds documents needs them as `history`, to verify what is repeated")
    # quantiles of doc_id, so that each batch reads its own part of a table sorted by it
    cuts = sorted(set(docs.approxQuantile("doc_id", [k / batches for k in range(1, batches)], 0.01))) if batches > 1 else []
    edges = [None, *map(int, cuts), None]
    found = []
    for low, high in zip(edges[:-1], edges[1:], strict=True):
        batch = docs
        if low is not None:
            batch = batch.where(F.col("doc_id") >= low)
        if high is not None:
            batch = batch.where(F.col("doc_id") < high)
        found.append(index.ingest(batch))
    prints = reduce(DataFrame.unionByName, found)
    # rows without an id neither remove nor lose anything
    known = docs.where("doc_id is not null")
    everything = known if history is None else known.unionByName(history.where("doc_id is not null"))
    out = []
    for k in range(ROUNDS):
        # the remainder of the unsigned number
        mine = F.pmod(F.pmod("print", F.lit(ROUNDS)) + F.when(F.col("print") < 0, F.lit((1 << 64) % ROUNDS)).otherwise(F.lit(0)), F.lit(ROUNDS)) == k
        shared = spark.sparkContext.broadcast(Filter.build(prints.where(mine)))
        # hashing again costs less than keeping the candidates: the scan is cheap, and they may be a third of all windows
        windows = "h1 long, h2 int, doc_id long"
        first = everything.select("doc_id", "text").mapInArrow(_candidates(shared, k, False), windows).groupBy("h1", "h2").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))
        first = materialize(first.where("first_doc < last_doc").select("h1", "h2", "first_doc"), "prints-first")
        later = known.mapInArrow(_candidates(shared, k, True), f"{windows}, text_hash long, at int").join(first, ["h1", "h2"]).where("doc_id > first_doc")
        out.append(materialize(later.select("doc_id", "text_hash", "at"), "prints-later"))
    return reduce(DataFrame.unionByName, out)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in text_slices(batches, "text"):
        n_words, n_removed, kept_text = [], [], []
        texts = part.column("text").cast(pa.binary()).to_pylist()
        for text, at in zip(texts, part.column("at"), strict=True):
            words = (text or b"").split()
            n_words.append(len(words))
            if at.is_valid and len(at.values):
                cover = np.zeros(len(words) + 1, np.int64)
                starts = np.unique(at.values.to_numpy())
                cover[starts] += 1
                np.add.at(cover, starts + WINDOW, -1)
                kept = np.flatnonzero(np.cumsum(cover[:-1]) == 0)
                n_removed.append(len(words) - len(kept))
                words = [words[k] for k in kept.tolist()]
            else:
                n_removed.append(0)
            kept_text.append(b" ".join(words))
        digests = [hashlib.sha256(x).hexdigest() for x in kept_text]
        yield pa.record_batch([part.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept_text, pa.binary()).cast(pa.string()), pa.array(digests)], names=["doc_id", "n_words", "n_removed", "kept", "kept_sha256"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", index: FingerprintIndex | None = None, history: DataFrame | None = None, batches: int = 3) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept (the words that stay, joined by a space), kept_sha256.

    With an `index` that holds earlier documents, pass those as `history` (same
    columns): what they hold is removed here too, and this batch joins the index.
    What earlier calls gave is not revised.

    Null texts have no words. Texts under 13 words lose nothing. Different texts
    with one doc_id are judged each for itself, and do not remove each other's
    words; repeated rows lose the same. A null doc_id is smaller than none and
    greater than none, so such a row loses nothing. An empty table gives an empty result. A text is
    handled whole; a task needs about 25 times the bytes of its longest one.
    """
    plain = lambda df: df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash"))
    texts = plain(docs)
    at = repeated_windows(texts, index, None if history is None else plain(history), batches)
    places = materialize(at.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set("at")).alias("at")), "prints-removed")
    return texts.join(places, ["doc_id", "text_hash"], "left").select("doc_id", "text", "at").mapInArrow(_cut, "doc_id long, n_words long, n_removed long, kept string, kept_sha256 string")
