"""Keeping stored tables equal to what is derived: diffs, reconciliation, completeness, upserts, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.market_time import Calendar
from .indicators import CATALOGUE, warmup
from .intervals import overlapping
from .tape import historical_contract

KEYS = ["venue", "instrument", "resolution_minutes"]
VALUE = [*KEYS, "indicator", "period", "bucket_start"]


def diff(produced: DataFrame, stored: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Rows to write or drop: `change` is insert, update or delete; equal rows are left out, so a second pass is empty."""
    new = produced.select(*keys, F.struct(*columns).alias("new"))
    old = stored.select(*keys, F.struct(*columns).alias("old"))
    rows = new.join(old, keys, "full")
    change = F.when(F.col("old").isNull(), "insert").when(F.col("new").isNull(), "delete").when(~F.col("new").eqNullSafe(F.col("old")), "update")
    rows = rows.withColumn("change", change).where("change is not null")
    return rows.select(*keys, *[F.col(f"new.{c}").alias(c) for c in columns], "change")


def upsert(stored: DataFrame, incoming: DataFrame, keys: list[str], columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """(new version, changed rows): incoming rows replace stored ones, and count as changed only if a column differs."""
    new = incoming.select(*keys, F.struct(*columns).alias("new"))
    old = stored.select(*keys, F.struct(*columns).alias("old"))
    rows = new.join(old, keys, "full")
    version = rows.select(*keys, F.coalesce("new", "old").alias("x")).select(*keys, *[F.col(f"x.{c}").alias(c) for c in columns])
    changed = rows.where("new is not null").where(~F.col("new").eqNullSafe(F.col("old"))).select(*keys, *[F.col(f"new.{c}").alias(c) for c in columns], F.when(F.col("old").isNull(), "insert").otherwise("update").alias("change"))
    return version, changed


def append_missing(stored: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Incoming rows whose key is not stored, once each; nothing is overwritten."""
    return incoming.dropDuplicates(keys).join(stored.select(*keys), keys, "left_anti")


def rounded(values: DataFrame) -> DataFrame:
    return values.withColumn("value", F.round("value", 8))


def project(produced: DataFrame, stored: DataFrame, tolerance: float = 5e-9) -> DataFrame:
    """Values that a projection writes: absent ones, and those that differ at eight places."""
    new = produced.select(*VALUE, F.col("value").alias("new"))
    old = stored.select(*VALUE, F.col("value").alias("old"))
    rows = new.join(old, VALUE, "left").where(F.col("old").isNull() | (F.abs(F.col("new") - F.col("old")) > tolerance))
    return rows.select(*VALUE, F.col("new").alias("value"), F.when(F.col("old").isNull(), "insert").otherwise("update").alias("change"))


def reconcile(stored: DataFrame, produced: DataFrame, bars: DataFrame, pairs: list[tuple[str, int]] = CATALOGUE) -> DataFrame:
    """Stored values that are not produced: orphaned (no bar), else retired (not in the catalogue), else unjustified."""
    extra = stored.join(produced.select(*VALUE), VALUE, "left_anti")
    held = bars.select(*KEYS, "bucket_start", F.lit(True).alias("_bar"))
    listed = F.concat_ws(":", "indicator", "period").isin([f"{n}:{p}" for n, p in pairs])
    rows = extra.join(held, [*KEYS, "bucket_start"], "left")
    return rows.select(*VALUE, "value", F.when(F.col("_bar").isNull(), "orphaned").when(~listed, "retired").otherwise("unjustified").alias("reason"))


def projection_changes(produced: DataFrame, stored: DataFrame) -> DataFrame:
    """The whole change of a stored projection: what is written, and what is no longer produced as deletes."""
    gone = stored.join(produced.select(*VALUE), VALUE, "left_anti").select(*VALUE, "value", F.lit("delete").alias("change"))
    return project(produced, stored).unionByName(gone)


def completeness(bars: DataFrame, stored: DataFrame, pairs: list[tuple[str, int]] = CATALOGUE) -> DataFrame:
    """Indicators of a series that should have a newer value: warm, but the newest value is older than the warm-up's bars, or absent."""
    needs = F.explode(F.array(*[F.struct(F.lit(n).alias("indicator"), F.lit(p).alias("period"), F.lit(warmup(n, p)).alias("warmup")) for n, p in pairs]))
    ranked = bars.withColumn("_rank", F.row_number().over(Window.partitionBy(*KEYS).orderBy(F.desc("bucket_start"))))
    asked = ranked.select(*KEYS, "_rank", F.col("bucket_start").alias("due_from"), needs.alias("x")).where("_rank = x.warmup").select(*KEYS, "x.*", "due_from")
    newest = stored.groupBy(*KEYS, "indicator", "period").agg(F.max("bucket_start").alias("newest"))
    rows = asked.join(newest, [*KEYS, "indicator", "period"], "left")
    return rows.withColumn("missing", F.coalesce(F.col("newest") < F.col("due_from"), F.lit(True)))


_PRICE = ["open", "high", "low", "close", "volume", "contract_id"]


def _reselection(by_contract: DataFrame, stored: DataFrame, calendar: Calendar) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The choice of each date, stored bars of decided dates beside it, winner bars to write, stored bars that go."""
    choices, winners = historical_contract(by_contract, calendar)
    keys = [*KEYS, "bucket_start"]
    _, changed = upsert(stored, winners, keys, _PRICE)
    dated = stored.withColumn("trade_date", F.coalesce(calendar.trade_date("bucket_start"), F.to_date("bucket_start")))
    chosen = choices.select(*KEYS, "trade_date", F.col("contract_id").alias("chosen"))
    dated = dated.join(chosen, [*KEYS, "trade_date"])
    removed = dated.where(~F.col("contract_id").eqNullSafe(F.col("chosen"))).join(winners.select(*keys), keys, "left_anti")
    return choices, dated, changed, removed


def reselection_changes(by_contract: DataFrame, stored: DataFrame, calendar: Calendar) -> DataFrame:
    """What choosing the contracts anew writes to the stored bars, as inserts, updates and deletes."""
    _, _, changed, removed = _reselection(by_contract, stored, calendar)
    columns = [*KEYS, "bucket_start", *_PRICE]
    return changed.select(*columns, "change").unionByName(removed.select(*columns, F.lit("delete").alias("change")))


def reselect(by_contract: DataFrame, stored: DataFrame, calendar: Calendar, coverage: DataFrame) -> DataFrame:
    """What choosing the contracts anew would change, per instrument.

    Winner bars are written; stored bars of other or unknown contracts on decided
    dates that the winner does not restate go; coverage that touches a decided
    date goes too.
    """
    choices, dated, changed, removed = _reselection(by_contract, stored, calendar)
    dates = dated.groupBy("venue", "instrument", "trade_date").agg(F.max(F.when(~F.col("contract_id").eqNullSafe(F.col("chosen")), 1).otherwise(0)).alias("moved"))
    # ranges and decided sessions meet under their instrument's days, up to the last decided one
    decided = choices.select("venue", "instrument", "trade_date").distinct()
    sessions = decided.select("venue", "instrument", calendar.session_open(F.col("trade_date")).alias("window_start"), calendar.ordinary_close(F.col("trade_date")).alias("window_end"))
    final = sessions.groupBy("venue", "instrument").agg(F.max("window_end").alias("_final"))
    touched = coverage.select("venue", "instrument", "contract_id", "range_start", "range_end").join(final, ["venue", "instrument"])
    cover = overlapping(touched, sessions.join(final, ["venue", "instrument"]), ["venue", "instrument"], F.col("_final"))
    count = lambda df, name: df.groupBy("venue", "instrument").agg(F.count("*").alias(name))
    out = count(choices, "dates")
    for df, name in (
        (changed, "revised"),
        (removed, "removed"),
        (removed.where("contract_id is null"), "unattributed"),
        (dates.where("moved = 1"), "dates_changed"),
        (cover.select("venue", "instrument", "contract_id", "range_start", "range_end").distinct(), "coverage_dropped"),
    ):
        out = out.join(count(df, name), ["venue", "instrument"], "left")
    return out.na.fill(0)


def coverage_memo(empties: DataFrame, now: Column, recent_days: int = 2, ttl_minutes: int = 15) -> DataFrame:
    """Empty ranges to remember: what lies before now - 2 days for good, the rest until now + 15 minutes."""
    line = now - F.make_dt_interval(days=F.lit(recent_days))
    parts = F.array(
        F.struct(F.col("range_start"), F.least(F.col("range_end"), line).alias("range_end"), F.lit(None).cast("timestamp_ntz").alias("expires_at")),
        F.struct(F.greatest(F.col("range_start"), line).alias("range_start"), F.col("range_end"), (now + F.make_dt_interval(mins=F.lit(ttl_minutes))).alias("expires_at")),
    )
    rows = empties.select("venue", "instrument", "contract_id", F.explode(parts).alias("x")).select("venue", "instrument", "contract_id", "x.*")
    return rows.where("range_start < range_end")


def source_counts(receipts: DataFrame, prints: DataFrame) -> DataFrame:
    """Each receipt with the rows of its key and day that the tape holds now, and when the last was recorded."""
    keys = ["venue", "instrument", "contract_id", "day"]
    now = prints.groupBy("venue", "instrument", "contract_id", F.to_date("trade_time_utc").alias("day")).agg(F.count("*").alias("source_rows"), F.max("recorded_at").alias("last_recorded"))
    return receipts.join(now, keys, "left").withColumn("source_rows", F.coalesce("source_rows", F.lit(0).cast("long")))


def receipts_missing(receipts: DataFrame, prints: DataFrame) -> DataFrame:
    days = prints.groupBy("venue", "instrument", "contract_id", F.to_date("trade_time_utc").alias("day")).agg(F.count("*").alias("source_rows"))
    return days.join(receipts.where("state = 'uploaded'"), ["venue", "instrument", "contract_id", "day"], "left_anti")


def retention_plan(receipts: DataFrame, prints: DataFrame) -> DataFrame:
    """What may be deleted of each exported key and day, or why not; days without a receipt are kept."""
    rows = source_counts(receipts, prints)
    n, had = F.col("source_rows"), F.col("row_count")
    action = (
        F.when((n > 0) & (n < had), "delete")
        .when((F.col("last_recorded") > F.col("exported_at")) & (n >= had), "withdraw: late rows")
        .when(n == had, "delete")
        .when(n == 0, "done")
        .otherwise("withdraw: count changed")
    )
    keep = receipts_missing(receipts, prints).select("venue", "instrument", "contract_id", "day", F.lit(None).cast("long").alias("row_count"), "source_rows", F.lit("keep").alias("action"))
    return rows.select("venue", "instrument", "contract_id", "day", F.col("row_count").cast("long").alias("row_count"), "source_rows", action.alias("action")).unionByName(keep)


def retention_changes(prints: DataFrame, receipts: DataFrame) -> DataFrame:
    """What retention deletes from the tape: prints of deletable key-days that were recorded by the export."""
    return _dated(prints, receipts).where("recorded_at <= exported_at").drop("exported_at", "day").withColumn("change", F.lit("delete"))


def retention_apply(prints: DataFrame, receipts: DataFrame) -> DataFrame:
    """The tape after deletion: prints of deletable key-days that were recorded by the export are gone."""
    rows = _dated(prints, receipts)
    return rows.where(F.col("exported_at").isNull() | (F.col("recorded_at") > F.col("exported_at"))).drop("exported_at", "day")


def _dated(prints: DataFrame, receipts: DataFrame) -> DataFrame:
    """Prints with the export of their day, if the plan deletes it."""
    plan = retention_plan(receipts, prints).where("action = 'delete'").join(receipts.select("venue", "instrument", "contract_id", "day", "exported_at"), ["venue", "instrument", "contract_id", "day"])
    return prints.withColumn("day", F.to_date("trade_time_utc")).join(plan.select("venue", "instrument", "contract_id", "day", "exported_at"), ["venue", "instrument", "contract_id", "day"], "left")


def late_rows(prints: DataFrame, receipts: DataFrame) -> DataFrame:
    """Prints recorded after their day was exported: those days have to be exported again."""
    rows = prints.withColumn("day", F.to_date("trade_time_utc")).join(receipts.select("venue", "instrument", "contract_id", "day", "exported_at"), ["venue", "instrument", "contract_id", "day"])
    return rows.where("recorded_at > exported_at").groupBy("venue", "instrument", "contract_id", "day").agg(F.count("*").alias("late"), F.max("recorded_at").alias("last_recorded"))
