"""Notes: appending, text search, vector search, reuse of vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import nearest


def content_hash(text: Column | str = "text") -> Column:
    return F.sha2(F.trim(text).cast("binary"), 256)


def append(notes: DataFrame, instruments: DataFrame) -> DataFrame:
    """Notes as they are stored: text trimmed and not blank, kind in lower case or `note`, symbol in upper case if it is known, tags never NULL."""
    rows = notes.withColumn("text", F.trim("text")).where(F.length("text") > 0)
    rows = rows.withColumn("kind", F.lower(F.coalesce(F.when(F.trim("kind") != "", F.trim("kind")), F.lit("note")))).withColumn("_symbol", F.upper(F.trim("instrument")))
    known = instruments.select(F.upper("symbol").alias("_symbol"), F.col("symbol"))
    rows = rows.join(known, "_symbol", "left")
    tags = F.coalesce("tags", F.array().cast("array<string>")) if "tags" in notes.columns else F.array().cast("array<string>")
    return rows.select("id", F.col("symbol").alias("instrument"), "kind", "text", tags.alias("tags"), "recorded_at", content_hash().alias("content_hash"))


def text_search(notes: DataFrame, query: str, k: int) -> DataFrame:
    """Newest notes that hold the query, in any case; a blank query finds all."""
    hit = notes if not query.strip() else notes.where(F.contains(F.lower("text"), F.lit(query.strip().lower())))
    return hit.orderBy(F.desc("recorded_at"), "id").limit(k)


def semantic_topk(vectors: DataFrame, queries: DataFrame, k: int, model: str, within: DataFrame | None = None, block: int = nearest.QUERY_BLOCK) -> DataFrame:
    """The k nearest notes of each query (query_id, query): cosine, ties by id. `within` (owner_id) limits the notes.

    The search is exact and visits only notes that can be among the nearest;
    see `nearest.search`, also for what takes no part.
    """
    rows = vectors.where(F.col("model") == model)
    if within is not None:
        rows = rows.join(within, "owner_id", "left_semi")
    return nearest.search(rows, queries, k, query_block=block)


def unsearchable(notes: DataFrame, vectors: DataFrame, model: str) -> DataFrame:
    have = vectors.where(F.col("model") == model).select(F.col("owner_id").alias("id"))
    return notes.join(have, "id", "left_anti")


def reuse_vectors(notes: DataFrame, vectors: DataFrame, model: str) -> DataFrame:
    """(id, from_id): notes without a vector that take the one of a note with the same text; the smallest id gives it."""
    have = vectors.where(F.col("model") == model).select(F.col("owner_id").alias("id"))
    hashed = notes.select("id", content_hash().alias("content_hash"))
    givers = hashed.join(have, "id", "left_semi").groupBy("content_hash").agg(F.min("id").alias("from_id"))
    return hashed.join(have, "id", "left_anti").join(givers, "content_hash").select("id", "from_id")
