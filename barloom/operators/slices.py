"""Running values of long series in two passes: pieces of a key are added up, what lies before a piece is carried to it, and rows are only windowed inside their piece."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .series import with_columns


def _prefix(rows: DataFrame, keys: list[str], piece: str, order: list[str], name: str, value: Column, add, before: bool) -> DataFrame:
    pieces = Window.partitionBy(*keys).orderBy(piece).rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy(*keys, piece).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    totals = rows.groupBy(*keys, piece).agg(add(value).alias("_total")).select(*keys, piece, add("_total").over(pieces).alias("_carry"))
    return rows.withColumn(name, add(value).over(inside)).transform(with_columns, totals, [*keys, piece])


def running_sum(rows: DataFrame, keys: list[str], piece: str, order: list[str], name: str, value: Column) -> DataFrame:
    """Adds `name`: the sum of `value` over the key's rows up to each row.

    `piece` numbers or dates pieces of a key in its order, and never holds NULL;
    `order` decides between all rows of a piece. A key meets in one task only as
    one row a piece, a piece as its rows. The rows are read twice: they should be
    a stored table or cheap. NULL keys are keys like others.
    """
    return _prefix(rows, keys, piece, order, name, value, F.sum, False).withColumn(name, F.coalesce(name, F.lit(0)) + F.coalesce("_carry", F.lit(0))).drop("_carry")


def running_max(rows: DataFrame, keys: list[str], piece: str, order: list[str], name: str, value: Column, before: bool = False) -> DataFrame:
    """As `running_sum`, the largest `value` so far; with `before`, of the rows before each row (NULL on a key's first)."""
    return _prefix(rows, keys, piece, order, name, value, F.max, before).withColumn(name, F.greatest(name, "_carry")).drop("_carry")
