"""A corpus pipeline: language, near-duplicates, benchmark decontamination, source mixing, token output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import decontamination, language_id, mixing, simhash, token_output
from barloom.llm.common import materialize, table
from barloom.llm.queries import END_ID, tokenizer_path

#: A document stays if its best language holds more than this share.
LEAST_SCORE = 0.5


def _row(docs: DataFrame):
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")


def _without(docs: DataFrame, gone: DataFrame, name: str) -> DataFrame:
    """The rows of `docs` whose doc_id and text are not in `gone` (doc_id, text_hash); ids may be missing or shared by different texts."""
    keyed = docs.select(_row(docs), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("hash"))
    gone = materialize(gone.select("doc_id", "text_hash").distinct(), name)
    return keyed.join(gone, keyed["id"].eqNullSafe(gone["doc_id"]) & (keyed["hash"] == gone["text_hash"]), "left_anti").select("row.*")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter (null and empty texts too), or whose language is a toss-up, go.

    Rows are judged one by one by their text, so repeated and missing ids make
    no difference; without labelled rows to learn from, all go.
    """
    found = language_id.identify(docs)
    return found.where((F.col("lang_pred") != language_id.UNDETERMINED) & (F.col("score") > LEAST_SCORE)).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one with the smallest doc_id, and of several texts with that id the one with the smallest hash.

    Rows without an id come last in this order. Rows that repeat id and text are
    one document and stay or go together. Null and empty texts are one group.
    """
    return _without(docs, simhash.near_duplicates(docs).where("not kept"), "pipeline-copies")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a twentieth of their words in benchmark windows go.

    Each text is judged by itself, whatever its id; texts without words stay, and
    so do all documents if the benchmark is empty.
    """
    found = decontamination.contamination(docs, table(spark, sf_dir, "benchmark"))
    return _without(docs, found.where(decontamination.is_contaminated(decontamination.hit_words(), F.col("n_words"))), "pipeline-contaminated")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come as often as their source's weight asks, in a new order.

    Repeated ids draw alike, missing ids draw as one; a null source is a source
    of its own.
    """
    return mixing.replicate(docs).select("row.*")


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files, read back: one row per document copy. Null texts hold the end id alone; rows without an id come first."""
    return token_output.read_documents(spark, token_output.token_archive(docs, tokenizer_path(), END_ID))


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("mix", mix),
    ("write_tokens", write_tokens),
]

#: A trained language model and an index search have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"pipeline-{name}")
    return docs
