"""Helpers that the corpus operators share: shared storage, Arrow slicing, word scanning."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession

from ..sources.storage import scratch

#: Bytes of text handled at once inside a task. Numpy temporaries are about 40 times this.
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Have Spark delete the shuffle files of the writes inside as soon as each has ended.

    A stored step is read from its table, so nothing needs its shuffles again.
    Else they stay until the driver happens to collect its garbage, and the steps
    of an operator pile up on the disks. The setting holds for the writes alone:
    actions that read on after their query has ended, such as toLocalIterator,
    belong outside, or in another session if they run at the same time.
    """
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage with a Parquet table in the shared folder, and read it back."""
    spark = df.sparkSession
    path = scratch(spark, name)
    with shuffles_dropped(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that the named text column holds about `limit` bytes a piece.

    A single longer text is a piece of its own; nothing is cut inside a text.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pa.compute.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        piece = np.cumsum(sizes.astype(np.int64))
        start = 0
        while start < batch.num_rows:
            base = piece[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(piece, base + limit, side="right")))
            yield batch.slice(start, end - start)
            start = end


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column, and the n + 1 offsets of its rows. Null is an empty text."""
    if pa.types.is_large_string(column.type) or pa.types.is_string_view(column.type):
        column = column.cast(pa.string())
    column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4).astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


_BASE = np.uint64(0x9E3779B97F4A7C55)  # odd, so that it has an inverse modulo 2**64
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C55, -1, 1 << 64))
_BASE2 = np.uint64(0xC2B2AE3D27D4EB4F)
_INVERSE2 = np.uint64(pow(0xC2B2AE3D27D4EB4F, -1, 1 << 64))
_powers: dict[int, np.ndarray] = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. base ** n, modulo 2**64."""
    have = _powers.get(int(base))
    if have is None or len(have) <= n:
        have = np.full(max(n + 1, 1 << 16), base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if len(have) <= 1 << 23:
            _powers[int(base)] = have
    return have[: n + 1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser: spreads a polynomial hash over all 64 bits."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def range_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, second: bool = False) -> np.ndarray:
    """A 64-bit hash of values[start:end] for each range, from one running sum."""
    base, inverse = (_BASE2, _INVERSE2) if second else (_BASE, _INVERSE)
    n = len(values)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(values.astype(np.uint64) * _power(base, n)[:n], out=total[1:])
    raw = (total[ends] - total[starts]) * _power(inverse, n)[starts]
    return mix(raw + (ends - starts).astype(np.uint64) * np.uint64(0x165667B19E3779F9))


class Words:
    """Words of a slice of texts: `start`, `end` in `raw`, and `row`, the first word of each text (n + 1 values)."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, is_word: np.ndarray):
        inside = np.zeros(len(raw) + 2, np.int8)
        inside[1:-1] = is_word[raw]
        edge = np.diff(inside)
        # a text boundary ends a word too
        cuts = np.unique(offsets[1:-1])
        cuts = cuts[(cuts > 0) & (cuts < len(raw))]
        joined = cuts[(inside[cuts] == 1) & (inside[cuts + 1] == 1)]
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if len(joined):
            start, end = np.sort(np.concatenate([start, joined])), np.sort(np.concatenate([end, joined]))
        self.raw, self.start, self.end = raw, start, end
        self.row = np.searchsorted(start, offsets)

    def hashes(self) -> np.ndarray:
        """A hash of each word; computed over a piece of the bytes at a time, which gives the same values with less memory."""
        out, first = np.empty(len(self.start), np.uint64), 0
        while first < len(out):
            last = max(first + 1, int(np.searchsorted(self.end, self.start[first] + SLICE_BYTES, side="right")))
            base = self.start[first]
            out[first:last] = range_hash(self.raw[base : self.end[last - 1]], self.start[first:last] - base, self.end[first:last] - base)
            first = last
        return out


def byte_table(separators: bytes) -> np.ndarray:
    """For each byte, 1 if it belongs to a word."""
    out = np.ones(256, np.int8)
    out[list(separators)] = 0
    return out


#: Words as `[^\x20\x09-\x0D]+`.
SPACED = byte_table(b" \t\n\x0b\x0c\r")
#: Words as `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` of lower-cased text.
ALNUM = byte_table(bytes([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def lowered(raw: np.ndarray) -> np.ndarray:
    """A-Z in lower case, all other bytes as they are."""
    return _LOWER[raw]
