"""The market-data tables as they are derived from the shared test tables (`events`, `orders`, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.market_time import align_down, plus_minutes, position

SERIES = ["venue", "instrument", "resolution_minutes"]
ROLL = "2024-01-16 22:00:00"
OPEN_END = "9999-12-31 00:00:00"


def ntz(text: str):
    return F.lit(text).cast("timestamp_ntz")


def raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _print_columns() -> list[Column]:
    even = F.col("user_id") % 2 == 0
    at = F.col("ts").cast("timestamp_ntz")
    return [
        F.lit("SIM").alias("venue"),
        F.when(even, "ES").otherwise("NQ").alias("instrument"),
        F.concat(F.lit("CON.F.US."), F.when(even, "EP").otherwise("ENQ"), F.lit("."), F.when(F.col("event_id") % 30 >= F.dayofmonth(at), "H24").otherwise("M24")).alias("contract_id"),
        at.alias("trade_time_utc"),
        F.col("event_id").alias("sequence"),
        (F.floor(F.col("value") * 4 + 0.5) / 4).cast("double").alias("price"),
        F.get_json_object("props", "$.k").cast("long").alias("size"),
        F.when(F.col("event_type").isin("click", "purchase"), 1).when(F.col("event_type").isin("view", "error"), 2).otherwise(0).alias("direction"),
        F.when(F.col("event_id") % 50 == 0, plus_minutes(at, 60)).otherwise(at + F.make_dt_interval(secs=F.lit(1))).alias("recorded_at"),
    ]


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prints: even users trade ES, odd ones NQ; purchases and clicks buy, views and errors sell."""
    return raw(spark, sf_dir, "events").select(*_print_columns())


def _ohlcv(prints: DataFrame, keys: list[str]) -> DataFrame:
    order = position(F.col("trade_time_utc"), F.col("sequence").cast("long"))
    return prints.groupBy(*keys).agg(
        F.min_by("price", order).alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", order).alias("close"),
        F.sum("size").alias("volume"),
    )


def bars_by_contract(spark: SparkSession, sf_dir: str, minutes: int = 60) -> DataFrame:
    prints = trades(spark, sf_dir).withColumn("resolution_minutes", F.lit(minutes)).withColumn("bucket_start", align_down("trade_time_utc", minutes))
    return _ohlcv(prints, [*SERIES, "contract_id", "bucket_start"])


def bars(spark: SparkSession, sf_dir: str, minutes: int = 60) -> DataFrame:
    """One contract a bucket: H24 before the roll, M24 from it on."""
    prints = trades(spark, sf_dir).withColumn("resolution_minutes", F.lit(minutes)).withColumn("bucket_start", align_down("trade_time_utc", minutes))
    product = F.when(F.col("instrument") == "ES", "EP").otherwise("ENQ")
    month = F.when(F.col("bucket_start") < ntz(ROLL), "H24").otherwise("M24")
    return _ohlcv(prints, [*SERIES, "bucket_start"]).withColumn("contract_id", F.concat(F.lit("CON.F.US."), product, F.lit("."), month))


def bars_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract is not known for three hours."""
    hidden = (F.col("bucket_start") >= ntz("2024-01-10 03:00:00")) & (F.col("bucket_start") < ntz("2024-01-10 06:00:00"))
    return bars(spark, sf_dir).withColumn("contract_id", F.when(~hidden, F.col("contract_id")))


def bars_gappy(spark: SparkSession, sf_dir: str, minutes: int = 60) -> DataFrame:
    hour = F.timestamp_diff("HOUR", ntz("1970-01-01 00:00:00"), F.col("bucket_start"))
    return bars(spark, sf_dir, minutes).where(hour % 97 != 0)


def tape_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When the tape was listened to: each contract and UTC day from first to last print, without one day, and an open range."""
    day = F.to_date("trade_time_utc")
    closed = (
        trades(spark, sf_dir)
        .groupBy("venue", "instrument", "contract_id", day.alias("day"))
        .agg(F.min("trade_time_utc").alias("range_start"), F.max("trade_time_utc").alias("last"))
        .where(F.col("day") != F.lit("2024-01-20").cast("date"))
        .select("venue", "instrument", "contract_id", "range_start", (F.col("last") + F.make_dt_interval(secs=F.lit(1))).alias("range_end"))
    )
    still = closed.where(F.col("contract_id").endswith("M24")).groupBy("venue", "instrument", "contract_id").agg(F.max("range_start").alias("range_start")).withColumn("range_end", ntz(OPEN_END))
    return closed.unionByName(still)


def export_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One receipt a key and day; some counts are off, one day has none."""
    t = trades(spark, sf_dir)
    per_day = t.groupBy("venue", "instrument", "contract_id", F.to_date("trade_time_utc").alias("day")).agg(F.count("*").alias("n"), F.max("recorded_at").alias("last"))
    n = F.dayofmonth("day")
    return per_day.where(F.col("day") != F.lit("2024-01-05").cast("date")).select(
        "venue",
        "instrument",
        "contract_id",
        "day",
        (F.col("n") + F.when(n % 7 == 0, 5).when(n % 11 == 0, -1).otherwise(0)).alias("row_count"),
        F.when((n % 11 == 0) | (n % 3 == 0), plus_minutes("last", 60)).otherwise(F.date_add("day", 1).cast("timestamp_ntz")).alias("exported_at"),
        F.lit("uploaded").alias("state"),
    )


def quote_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views and clicks are quotes around the price, purchases are trades."""
    from ..functions.market_time import SAMPLE_CALENDAR

    t = raw(spark, sf_dir, "events").select(*_print_columns(), "event_type")
    quote, trade = F.col("event_type").isin("view", "click"), F.col("event_type") == "purchase"
    price = F.col("price")
    return t.where(quote | trade).select(
        "venue",
        "instrument",
        "contract_id",
        "sequence",
        F.when(quote, price - 0.25).otherwise(0.0).alias("bid"),
        F.when(quote, price + 0.25).otherwise(0.0).alias("ask"),
        F.when(trade, price).otherwise(0.0).alias("last"),
        F.when(trade, F.col("size")).otherwise(0).cast("long").alias("volume"),
        F.when(quote, F.col("trade_time_utc")).alias("quote_time_utc"),
        F.col("trade_time_utc").alias("received_at"),
        F.when(trade, F.col("trade_time_utc")).alias("last_at"),
        F.when(trade, F.col("trade_time_utc")).alias("volume_at"),
        quote.alias("book_known"),
        SAMPLE_CALENDAR.trade_date("trade_time_utc").alias("trade_date"),
    )


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = raw(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("id"),
        F.col("source").alias("instrument"),
        F.col("lang").alias("kind"),
        "text",
        plus_minutes(ntz("2024-01-01 00:00:00"), F.col("doc_id").cast("int")).alias("recorded_at"),
    )


def note_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("owner_id"), F.lit("m1").alias("model"), "embedding")


def instruments(spark: SparkSession) -> DataFrame:
    rows = [("ES", "EP", 0.25, 50.0), ("NQ", "ENQ", 0.25, 20.0), ("MES", "MES", 0.25, 5.0), ("MNQ", "MNQ", 0.25, 2.0)]
    return spark.createDataFrame(rows, "symbol string, product_code string, tick_size double, point_value double")

