"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Each source's target is its share of all characters to this power (1: as it is, 0: all sources alike).
ALPHA = 0.5
SEED = 17
#: No draw is larger: the chance of more is under 1e-12 for rates to 40; higher rates are cut in parts of at most this.
_PART, _TERMS = 8.0, 48


def draw52(key: Column, seed: int, part: Column | int = 0) -> Column:
    """52 bits of an MD5 of seed, part and key, as a long: alike on every engine and at every run."""
    part = F.lit(part) if isinstance(part, int) else part
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), part.cast("string"), F.coalesce(key.cast("string"), F.lit("null"))).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long")


def uniform(key: Column, seed: int, part: Column | int = 0) -> Column:
    """The same bits as a number in [0, 1)."""
    return draw52(key, seed, part).cast("double") / F.lit(float(1 << 52))


def poisson(rate: Column, u: Column) -> Column:
    """The least k with u < P(X <= k), X of mean `rate` (at most _PART): the distribution function inverted by its terms."""
    # rate and u go along in the state, so that each is computed once a row
    start = F.struct(F.exp(-rate).alias("term"), F.exp(-rate).alias("sum"), F.lit(0).alias("k"), rate.alias("rate"), u.alias("u"))

    def step(acc: Column, i: Column) -> Column:
        term = acc["term"] * acc["rate"] / i
        return F.struct(term.alias("term"), (acc["sum"] + term).alias("sum"), (acc["k"] + F.when(acc["u"] >= acc["sum"], 1).otherwise(0)).alias("k"), acc["rate"].alias("rate"), acc["u"].alias("u"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(_TERMS)), start, step, lambda acc: acc["k"])


def source_rates(docs: DataFrame, source: str, text: str, alpha: float = ALPHA) -> DataFrame:
    """(source, rate): how often a document of each source should come on average, for the total to stay as it is.

    A null source is a source of its own.
    """
    sizes = docs.groupBy(F.col(source).alias("source")).agg(F.sum(F.coalesce(F.length(text), F.lit(0)).cast("double")).alias("chars"))
    sizes = sizes.where("chars > 0")
    whole = sizes.agg(F.sum("chars").alias("chars"), F.sum(F.pow("chars", F.lit(alpha))).alias("weight")).first()
    share = F.pow("chars", F.lit(alpha)) / F.lit(whole["weight"] or 1.0)
    return sizes.select("source", (share * F.lit(whole["chars"] or 0.0) / F.col("chars")).alias("rate"))


def replicate(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", rates: DataFrame | None = None, alpha: float = ALPHA, seed: int = SEED, partitions: int | None = None) -> DataFrame:
    """Every row of `docs`, as often as a Poisson draw says, in an order shuffled over the whole result.

    (row, copy, place): row holds all columns, copy counts from 1, place is the
    hash by which the result is dealt out and sorted. The draw depends on seed
    and key only; its mean is the rate of the row's source (`rates`: source,
    rate; by default from `source_rates`). Rates over 8 are drawn in parts, whose
    sum is Poisson too. Sources without a rate (all texts empty or null) keep
    each row once. Repeated keys draw alike. Empty tables give an empty result.
    """
    if rates is None:
        rates = source_rates(docs, source, text, alpha)
    # a table of its own: both sides of the join are then plain exchanges, and a hot source's partition can be split
    rates = materialize(rates.select(F.col("source").alias("_source"), F.col("rate").alias("_rate")), "mixing-rates")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    drawn = packed.join(rates, packed["row"][source].eqNullSafe(rates["_source"]), "left")
    rate = F.coalesce("_rate", F.lit(1.0))
    parts = F.ceil(rate / _PART).cast("int")
    k = F.aggregate(
        F.sequence(F.lit(1), F.greatest(parts, F.lit(1))),
        F.lit(0),
        lambda acc, part: acc + poisson(rate / F.greatest(parts, F.lit(1)), uniform(F.col("row")[key], seed, part)),
    )
    n = F.when(F.col("_rate").isNull(), 1).otherwise(k)
    copies = drawn.select("row", n.alias("n")).where("n > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy"))
    placed = copies.withColumn("place", draw52(F.concat_ws("/", F.col("row")[key].cast("string"), F.col("copy").cast("string")), seed + 1))
    n_parts = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return placed.repartition(n_parts, "place").sortWithinPartitions("place", "copy")
