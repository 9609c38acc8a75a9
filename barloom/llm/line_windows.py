"""Line dedup over overlapping windows of three lines, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

WINDOW = 3


def _lines(text: str):
    return F.coalesce(F.split(F.col(text), "\n", -1), F.array().cast("array<string>"))


def line_windows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text_hash, pos, h1, h2): every run of three lines of a text, its first line counted from 0, as a 128-bit hash."""
    texts = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), _lines(text_col).alias("l"))
    shifted = F.arrays_zip(F.col("l").alias("a"), F.slice("l", 2, F.greatest(F.size("l"), F.lit(1))).alias("b"), F.slice("l", 3, F.greatest(F.size("l"), F.lit(1))).alias("c"))
    runs = texts.where(F.size("l") >= WINDOW).select("doc_id", "text_hash", F.posexplode(shifted).alias("pos", "w")).where("w.c is not null")
    return runs.select("doc_id", "text_hash", "pos", F.xxhash64("w.a", "w.b", "w.c").alias("h1"), F.xxhash64(F.lit(1), "w.c", "w.b", "w.a").alias("h2"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, n_lines, n_removed, kept): row holds all columns of `docs`, kept is the text without its removed lines.

    A window is three consecutive lines, split at newlines only; its first
    occurrence is the one with the smallest (doc_id, line). The lines of every
    later occurrence go; overlapping windows are merged. Windows are judged on
    the input. A text under three lines is left as it is; a null text has no
    lines and stays null; an empty text is one empty line. Different texts with
    one doc_id are documents of their own, in the order of a hash of their text;
    rows that repeat both doc_id and text are one document and keep or lose the
    same lines. A null doc_id is an id that comes before all others. An empty
    table gives an empty result. Texts are handled whole, as one array of lines.
    """
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    windows = line_windows(packed, "doc_id", "text")
    place = F.struct("doc_id", "text_hash", "pos")
    # partial minima first, so a window that a third of the corpus holds is one row a task
    repeated = windows.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").select("h1", "h2", "first")
    repeated = materialize(repeated, "line-windows")
    later = windows.join(repeated, ["h1", "h2"]).where(place > F.col("first"))
    gone = later.groupBy(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash")).agg(F.array_sort(F.collect_set("pos")).alias("gone"))
    joined = packed.join(gone, F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.xxhash64("text") == F.col("gone_hash")), "left").select("row", "text", "gone", _lines("text").alias("lines"))
    # between one removed window and the next stand the lines that are kept
    before = F.concat(F.array(F.lit(-WINDOW)), F.coalesce("gone", F.array().cast("array<int>")))
    after = F.concat(F.coalesce("gone", F.array().cast("array<int>")), F.array(F.size("lines")))
    kept = F.flatten(F.zip_with(before, after, lambda a, b: F.slice(F.col("lines"), a + WINDOW + 1, F.greatest(b - a - WINDOW, F.lit(0)))))
    kept = F.when(F.col("gone").isNull(), F.col("lines")).otherwise(kept)
    cut = joined.select("row", "text", F.size("lines").cast("long").alias("n_lines"), kept.alias("kept"))
    return cut.select("row", "n_lines", (F.col("n_lines") - F.size("kept")).alias("n_removed"), F.when(F.col("text").isNotNull(), F.array_join("kept", "\n")).alias("kept"))
