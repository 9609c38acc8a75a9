"""Accounts: positions, orders and fills as reports, contract use against a daily cap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.contracts import order_side, order_status
from ..functions.market_time import Calendar, market_date, market_minute


def signed_positions(positions: DataFrame) -> DataFrame:
    """Long as it is, short negative, flat zero; a size without a known side is an error row."""
    side, size = F.col("side"), F.col("size")
    signed = F.when(side == "long", size).when(side == "short", -size).when(size == 0, F.lit(0).cast("long"))
    return positions.withColumn("signed", signed).withColumn("error", F.when(signed.isNull(), "unknown side"))


def fills_window(fills: DataFrame, start: Column, end: Column) -> DataFrame:
    inside = fills.where((F.col("created_at") >= start) & (F.col("created_at") < end))
    return inside.withColumn("side", order_side("side")).withColumn("voided", F.coalesce("voided", F.lit(False))).withColumn("fees", F.coalesce("fees", F.lit(0.0)))


def orders_report(orders: DataFrame, open_only: bool = False) -> DataFrame:
    rows = orders.withColumn("status", order_status("status")).withColumn("side", order_side("side"))
    return rows.where("status in ('open', 'pending')") if open_only else rows


def cap_usage(audit: DataFrame, calendar: Calendar) -> DataFrame:
    """Contracts that each account attempted, by session day: a day begins at the evening's reopening."""
    day = F.when(market_minute("at_utc") >= calendar.open, F.date_add(market_date("at_utc"), 1)).otherwise(market_date("at_utc"))
    return audit.where("outcome = 'Attempted'").withColumn("cap_day", day).groupBy("account_id", "cap_day").agg(F.sum("contracts").alias("contracts"))
