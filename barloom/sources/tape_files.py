"""Tape files: finished UTC days as Parquet and gzipped CSV, their manifest and their check against the source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = ["venue", "instrument", "contract_id", "day"]
FOOTPRINT_KEY = ["venue", "instrument", "resolution_minutes", "day"]
TRADE_SCHEMA = "trade_time_utc timestamp_ntz, sequence long, price decimal(18,8), size long, direction int, recorded_at timestamp_ntz"
COVERAGE_SCHEMA = "range_start timestamp_ntz, range_end timestamp_ntz, recorded_at timestamp_ntz"
FOOTPRINT_SCHEMA = "bucket_start timestamp_ntz, price decimal(18,8), buy_volume long, sell_volume long, recorded_at timestamp_ntz"


def finished(rows: DataFrame, instant: str, now) -> DataFrame:
    """Rows of UTC days that have ended."""
    return rows.withColumn("day", F.to_date(instant)).where(F.date_add("day", 1).cast("timestamp_ntz") <= now)


def _export(rows: DataFrame, keys: list[str], order: list[str], path: str, kind: str) -> None:
    """One folder for each key and day, its rows in order; all rows of a key and day come from one task."""
    rows = rows.repartition(*keys).sortWithinPartitions(*keys, *order)
    if kind == "csv":
        stamp = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias(c)
        rows = rows.select(*[stamp(f.name) if f.dataType.typeName() == "timestamp_ntz" else F.col(f.name) for f in rows.schema])
        rows.write.partitionBy(*keys).option("header", True).option("compression", "gzip").csv(path)
    else:
        rows.write.partitionBy(*keys).parquet(path)


def _columns(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def export_trades(prints: DataFrame, path: str, now, kind: str = "parquet") -> None:
    """Prints of finished days, by (time, sequence)."""
    rows = finished(prints, "trade_time_utc", now).withColumn("price", F.col("price").cast("decimal(18,8)"))
    _export(rows.select(*KEY, *_columns(TRADE_SCHEMA)) if kind == "csv" else rows, KEY, ["trade_time_utc", "sequence"], path, kind)


def export_coverage(coverage: DataFrame, path: str, now, open_end, kind: str = "parquet") -> None:
    """Closed ranges (with recorded_at) by the day that they start on; what is still listened to is not exported."""
    rows = finished(coverage.where(F.col("range_end") < open_end), "range_start", now)
    _export(rows.select(*KEY, *_columns(COVERAGE_SCHEMA)), KEY, ["range_start", "range_end"], path, kind)


def export_footprint(cells: DataFrame, path: str, now, kind: str = "parquet") -> None:
    """Footprint cells (with resolution_minutes and recorded_at) by (bucket, price); cells are not of one contract alone."""
    rows = finished(cells, "bucket_start", now).withColumn("price", F.col("price").cast("decimal(18,8)"))
    _export(rows.select(*FOOTPRINT_KEY, *_columns(FOOTPRINT_SCHEMA)), FOOTPRINT_KEY, ["bucket_start", "price"], path, kind)


def _read(spark: SparkSession, path: str, schema: str, keys: list[str], kind: str) -> DataFrame:
    """Fixed types; in CSV instants may have seven digits of a second and are cut to microseconds."""
    typed = {"resolution_minutes": "int", "day": "date"}
    whole = ", ".join([schema, *(f"{k} {typed.get(k, 'string')}" for k in keys)])
    if kind == "parquet":
        return spark.read.schema(whole).parquet(path).select(*keys, *_columns(schema))
    rows = spark.read.schema(whole.replace("timestamp_ntz", "string")).option("header", True).option("quote", '"').option("escape", '"').csv(path)
    instant = lambda c: F.substring(F.regexp_replace(F.regexp_replace(c, "Z$", ""), "T", " "), 1, 26).cast("timestamp_ntz").alias(c)
    stamps = {c.split()[0] for c in schema.split(", ") if c.endswith("timestamp_ntz")}
    return rows.select(*keys, *[instant(c) if c in stamps else c for c in _columns(schema)])


def read_coverage(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    return _read(spark, path, COVERAGE_SCHEMA, KEY, kind)


def read_footprint(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    return _read(spark, path, FOOTPRINT_SCHEMA, FOOTPRINT_KEY, kind)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, TRADE_SCHEMA, KEY, "csv")


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, TRADE_SCHEMA, KEY, "parquet")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes, sha256) of each file; key and day are read off its folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "part-*").load(path)
    part = lambda name: F.regexp_extract("path", f"/{name}=([^/]+)/", 1).alias(name)
    return files.select(*map(part, KEY), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def verify(written: DataFrame, prints: DataFrame, now) -> DataFrame:
    """Keys and days whose file rows differ from the source rows; an empty result is a good export."""
    files = written.groupBy(*KEY).agg(F.count("*").alias("file_rows"))
    source = finished(prints, "trade_time_utc", now).groupBy(*KEY).agg(F.count("*").alias("source_rows"))
    rows = source.join(files, KEY, "full").na.fill(0, ["file_rows", "source_rows"])
    return rows.where("file_rows <> source_rows")


def pending_days(trades: DataFrame, coverage: DataFrame, cells: DataFrame, receipts: DataFrame, now, open_end) -> DataFrame:
    """Finished days of trades, closed coverage or footprints that have no receipt."""
    key = ["venue", "instrument", "day"]
    done = receipts.where("state = 'uploaded'").select(*key).distinct()
    closed = coverage.where(F.col("range_end") < open_end)
    days = [finished(rows, at, now).select(*key).distinct().join(done, key, "left_anti") for rows, at in ((trades, "trade_time_utc"), (closed, "range_start"), (cells, "bucket_start"))]
    return days[0].unionByName(days[1]).unionByName(days[2]).distinct()
