"""Frames of the last n rows of a run at a cost that does not depend on n, in chunks of a run that tasks share.

A frame of n rows is the end of one piece of n rows and the start of the next, so
it is put together from a running value from the front of each piece and one from
its back: two running windows, whatever n is, and no difference of long sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.contracts import typical_price
from ..sources.storage import stored
from .series import BLOCK_ROWS, RUN
from .slices import running_sum

CHUNK = [*RUN, "_chunk"]


def numbered(rows: DataFrame) -> DataFrame:
    """Rows of `runs_in_blocks` with `_n`, their number in their run from 1 on; a stored table."""
    return stored(running_sum(stored(rows, "rows"), RUN, "block", ["bucket_start"], "_n", F.lit(1)), "numbered")


def chunked(rows: DataFrame, before: int, after: int = 0, chunk_rows: int = BLOCK_ROWS) -> DataFrame:
    """Numbered rows in chunks of each run, with copies of the rows that lie up to `before` before and `after` behind a chunk.

    Chunks hold at least four times what is copied, so at most half of the rows
    come twice. `_own` tells a chunk's own rows.
    """
    size = max(chunk_rows, 4 * (before + after))
    at = F.col("_n") - 1
    home = F.floor(at / size)
    places = F.array(home, F.when(at % size >= size - before, home + 1), F.when((at % size < after) & (home > 0), home - 1))
    rows = rows.withColumn("_home", home).withColumn("_chunk", F.explode(F.filter(places, lambda c: c.isNotNull())))
    return rows.withColumn("_own", F.col("_chunk") == F.col("_home")).drop("_home")


class Frame:
    """The last n rows of a chunk, for one n: running values of its pieces and how they meet."""

    def __init__(self, n: int) -> None:
        self.n = n
        piece = Window.partitionBy(*CHUNK, F.floor(F.col("_n") / n))
        self.front = piece.orderBy("_n").rowsBetween(Window.unboundedPreceding, 0)
        self.back = piece.orderBy(F.desc("_n")).rowsBetween(Window.unboundedPreceding, 0)
        self.chunk = Window.partitionBy(*CHUNK).orderBy("_n")
        # the last row of a piece is the end of a frame that is this piece alone
        self.whole = F.col("_n") % n == n - 1

    def over(self, rows: DataFrame, values: dict[str, Column]) -> DataFrame:
        """Adds `<name>_a` and `<name>_b` for each running aggregate: its value over the frame's part in the piece before (NULL if none) and in the row's own piece."""
        rows = rows.withColumns({f"{k}_b": v.over(self.front) for k, v in values.items()} | {f"_{k}_back": v.over(self.back) for k, v in values.items()})
        part = lambda k: F.when(~self.whole, F.lag(f"_{k}_back", self.n - 1).over(self.chunk)) if self.n > 1 else F.lit(None).cast("double")
        return rows.withColumns({f"{k}_a": part(k) for k in values}).drop(*[f"_{k}_back" for k in values])


def _added(k: str) -> Column:
    return F.coalesce(f"{k}_a", F.lit(0.0)) + F.coalesce(f"{k}_b", F.lit(0.0))


def averages(rows: DataFrame, n: int) -> DataFrame:
    """Adds sma_<n> and _deviation_<n>, mean and population deviation of the last n closes, to chunks.

    Closes are taken from the first one of the chunk, and deviations of the two
    parts are merged by their squares around their own means, so that a large
    price level costs no digits. A close that is NULL or not a number is not one
    of the values, as in an average over a frame.
    """
    frame = Frame(n)
    rows = rows.withColumn("_base", F.first(F.when(~F.isnan("close"), F.col("close")), ignorenulls=True).over(frame.chunk.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("_x", F.when(F.isnan("close"), F.col("close")).otherwise(F.col("close") - F.col("_base")))
    rows = frame.over(rows, {"_c": F.count("_x"), "_s": F.sum("_x"), "_v": F.var_pop("_x")})
    count = F.coalesce("_c_a", F.lit(0)) + F.col("_c_b")
    total = _added("_s")
    squares = F.coalesce(F.col("_v_a") * F.col("_c_a"), F.lit(0.0)) + F.coalesce(F.col("_v_b") * F.col("_c_b"), F.lit(0.0))
    both = (F.coalesce("_c_a", F.lit(0)) > 0) & (F.col("_c_b") > 0)
    apart = F.col("_s_b") / F.nullif(F.col("_c_b"), F.lit(0)) - F.col("_s_a") / F.nullif(F.col("_c_a"), F.lit(0))
    squares = squares + F.when(both, apart * apart * F.col("_c_a") * F.col("_c_b") / F.nullif(count, F.lit(0))).otherwise(0.0)
    warm = (F.col("_n") >= n) & (count > 0)
    rows = rows.withColumn(f"sma_{n}", F.when(warm, F.col("_base") + total / count)).withColumn(f"_deviation_{n}", F.when(warm, F.sqrt(squares / count)))
    return rows.drop("_base", "_x", *[f"{k}_{p}" for k in ("_c", "_s", "_v") for p in "ab"])


def volume_prices(rows: DataFrame, n: int) -> DataFrame:
    """Adds vwap_rolling_<n>: typical price by volume over the last n rows; NULL while nothing has traded in them."""
    rows = Frame(n).over(rows, {"_pv": F.sum(typical_price() * F.col("volume")), "_q": F.sum("volume")})
    rows = rows.withColumn(f"vwap_rolling_{n}", F.when((F.col("_n") >= n) & (_added("_q") > 0), _added("_pv") / _added("_q")))
    return rows.drop("_pv_a", "_pv_b", "_q_a", "_q_b")


def extremes(rows: DataFrame, n: int, high: str, low: str, names: tuple[str, str]) -> DataFrame:
    """Adds the largest `high` and the smallest `low` of the last n rows to chunks; near a run's start, of those that there are."""
    rows = Frame(n).over(rows, {"_h": F.max(high), "_l": F.min(low)})
    return rows.withColumn(names[0], F.greatest("_h_a", "_h_b")).withColumn(names[1], F.least("_l_a", "_l_b")).drop("_h_a", "_h_b", "_l_a", "_l_b")


def framed(rows: DataFrame, families: list[tuple[str, int]], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Rows of `runs_in_blocks` with the columns of the families sma, bb and vwap_rolling, for any periods, by chunks."""
    rows = chunked(numbered(rows), max(n for _, n in families) - 1, chunk_rows=block_rows)
    for n in sorted({n for f, n in families if f in ("sma", "bb")}):
        rows = averages(rows, n)
        mean, deviation = F.col(f"sma_{n}"), F.col(f"_deviation_{n}")
        if ("bb", n) in families:
            rows = rows.withColumns({f"bb_middle_{n}": mean, f"bb_upper_{n}": mean + 2 * deviation, f"bb_lower_{n}": mean - 2 * deviation})
        rows = rows.drop(f"_deviation_{n}", *([] if ("sma", n) in families else [f"sma_{n}"]))
    for n in sorted({n for f, n in families if f == "vwap_rolling"}):
        rows = volume_prices(rows, n)
    return rows.where("_own").drop("_own", "_chunk", "_n")
