"""The live side: prints to tape rows, coverage ranges, print gate, latest quotes, footprints and recorder health."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from datetime import timezone

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window


from ..functions.market_time import position
from ..operators.intervals import complement, overlapping
from ..sources.storage import scratch
from ..sources.storage import stored as written

OPEN_END = pd.Timestamp("9999-12-31")
CONTRACT = ["venue", "instrument", "contract_id"]
CARRY_MINUTES, STALE_SECONDS = 30, 15


def read_events(spark: SparkSession, folder: str, name: str = "events") -> DataFrame:
    """The table as a stream of files."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def drain(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there into Parquet files, and read them."""
    spark = stream.sparkSession
    path = scratch(spark, name)
    with rocksdb_state(spark):
        query = stream.writeStream.outputMode(mode).format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


def tape_rows(prints: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Tape rows of one batch: blank contracts dropped, sizes cut to whole numbers, sequence counting on from the stored maximum."""
    rows = prints.where(F.length(F.trim("contract_id")) > 0).withColumn("size", F.col("size").cast("long"))
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*CONTRACT).orderBy("trade_time_utc", "source_id")))
    if stored is not None:
        last = stored.groupBy(*CONTRACT).agg(F.max("sequence").alias("_last"))
        rows = rows.join(last, CONTRACT, "left")
    else:
        rows = rows.withColumn("_last", F.lit(0).cast("long"))
    return rows.withColumn("sequence", F.coalesce("_last", F.lit(0)) + F.col("_n")).drop("_n", "_last", "source_id")


def stream_tape(prints: DataFrame) -> DataFrame:
    """Write a stream of prints as tape rows. A batch's files have its number, so a batch that is run again replaces itself.

    Beside them each batch leaves the last sequence of every contract so far, one
    row a contract, and the next one reads that alone: a batch costs what it
    holds, however many came before.
    """
    spark = prints.sparkSession
    path = scratch(spark, "tape")
    schema = "venue string, instrument string, contract_id string, trade_time_utc timestamp_ntz, price double, size long, direction int, sequence long"
    last_schema = "venue string, instrument string, contract_id string, sequence long"

    def write(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        before = session.read.schema(last_schema).parquet(f"{path}/last/batch={number - 1}") if number else session.createDataFrame([], last_schema)
        tape_rows(batch, before).write.mode("overwrite").parquet(f"{path}/rows/batch={number}")
        written = session.read.schema(schema).parquet(f"{path}/rows/batch={number}").select(*CONTRACT, "sequence")
        last = before.unionByName(written).groupBy(*CONTRACT).agg(F.max("sequence").alias("sequence"))
        last.write.mode("overwrite").parquet(f"{path}/last/batch={number}")

    prints.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(f"{schema}, batch int").parquet(f"{path}/rows").drop("batch")


DAYS = "venue string, instrument string, contract_id string, newest timestamp_ntz"


def stream_days(prints: DataFrame, path: str, delay_minutes: int = 10) -> tuple[DataFrame, DataFrame]:
    """(rows on time, late rows) of a stream, under `path`, where a later call goes on with what has come since.

    A contract's day is closed, and may have been exported, once a print of an
    earlier batch lies `delay_minutes` behind the day's end; a row of a closed day
    is late. Each row is in one of the two, whatever its columns hold; one
    without an instant is on time. Every batch writes its rows once, in files
    of its number, and beside them the newest instant of each contract so far,
    one row a contract: a batch that runs again replaces itself, and none reads
    what came before. `prints` must not have columns batch, late or day.
    """
    if {"batch", "late", "day"} & set(prints.columns):
        raise ValueError("batch, late and day are columns of the result")
    spark = prints.sparkSession
    # a stream that brings nothing leaves this
    spark.createDataFrame([], prints.schema).write.mode("overwrite").parquet(f"{path}/rows/batch=-1/late=false")

    def write(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        before = session.read.schema(DAYS).parquet(f"{path}/newest/batch={number - 1}") if number else session.createDataFrame([], DAYS)
        known = before.withColumnsRenamed({c: f"_{c}" for c in (*CONTRACT, "newest")})
        closed = F.date_add(F.to_date("trade_time_utc"), 1).cast("timestamp_ntz") + F.make_dt_interval(mins=F.lit(delay_minutes)) <= F.col("_newest")
        rows = batch.join(known, [batch[c].eqNullSafe(known[f"_{c}"]) for c in CONTRACT], "left").select(*[batch[c] for c in batch.columns], F.coalesce(closed, F.lit(False)).alias("late"))
        rows.write.mode("overwrite").partitionBy("late").parquet(f"{path}/rows/batch={number}")
        written = session.read.schema(rows.schema).parquet(f"{path}/rows/batch={number}").select(*CONTRACT, F.col("trade_time_utc").alias("newest"))
        newest = before.unionByName(written).groupBy(*CONTRACT).agg(F.max("newest").alias("newest"))
        newest.write.mode("overwrite").parquet(f"{path}/newest/batch={number}")

    prints.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in prints.schema], "batch int", "late boolean"])
    rows = spark.read.schema(schema).option("basePath", f"{path}/rows").parquet(f"{path}/rows")
    return rows.where("not late").drop("late", "batch"), rows.where("late").drop("late").withColumn("day", F.to_date("trade_time_utc"))


def days_to_export(late: DataFrame) -> DataFrame:
    """Days that late rows of `stream_days` came to: they have to be exported again, with the last batch that touched them."""
    return late.groupBy(*CONTRACT, "day").agg(F.count("*").alias("late"), F.min("trade_time_utc").alias("first_at"), F.max("batch").cast("long").alias("last_batch"))


def coverage_batch(changes: DataFrame) -> DataFrame:
    """Ranges of listening from connects and drops (venue, instrument, at, kind, event_id) in one pass.

    A drop closes the connect just before it; a connect that another connect
    follows was abandoned; the last connect stays open to 9999-12-31. Empty
    ranges are left out.
    """
    w = Window.partitionBy("venue", "instrument").orderBy("at", "event_id")
    rows = changes.withColumn("_next", F.lead("kind").over(w)).withColumn("_end", F.lead("at").over(w)).where("kind = 'connect' and (_next is null or _next = 'drop')")
    return rows.select("venue", "instrument", F.col("at").alias("range_start"), F.coalesce("_end", F.lit("9999-12-31").cast("timestamp_ntz")).alias("range_end")).where("range_start < range_end")


def stream_coverage(changes: DataFrame) -> DataFrame:
    """The same as a stream, one open start as the state of each instrument; closed ranges are emitted as they close."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start = state.get[0] if state.exists else None
        out = []
        for row in pd.concat(list(batches)).sort_values(["at", "event_id"]).itertuples():
            if row.kind == "connect":
                start = row.at
            elif start is not None:
                if start < row.at:
                    out.append((*key, start, row.at))
                start = None
        state.update((start,))
        yield pd.DataFrame(out, columns=["venue", "instrument", "range_start", "range_end"])

    grouped = changes.groupBy("venue", "instrument")
    return grouped.applyInPandasWithState(fold, "venue string, instrument string, range_start timestamp_ntz, range_end timestamp_ntz", "start timestamp_ntz", "append", GroupStateTimeout.NoTimeout)


def print_gate(prints: DataFrame, coverage: DataFrame) -> DataFrame:
    """Prints that an open or closed range of their contract covers.

    Closed ranges are spread over their days for an equality key. Open ones
    (no end, or one in the year 9999) need none: of a contract's open ranges the
    earliest start decides, whatever the day of the print.
    """
    is_open = F.col("range_end").isNull() | (F.year("range_end") >= 9999)
    listening = coverage.where(is_open).groupBy(*CONTRACT).agg(F.min("range_start").alias("_from"))
    closed = coverage.where(~is_open & (F.col("range_start") < F.col("range_end")))
    days = closed.withColumn("_day", F.explode(F.sequence(F.to_date("range_start"), F.to_date("range_end"))))
    # several ranges of a day must not repeat a print: each is one array of ranges
    days = days.groupBy(*CONTRACT, "_day").agg(F.collect_list(F.struct("range_start", "range_end")).alias("_ranges"))
    rows = prints.withColumn("_day", F.to_date("trade_time_utc")).join(days, [*CONTRACT, "_day"], "left").join(listening, CONTRACT, "left")
    at = F.col("trade_time_utc")
    inside = F.exists("_ranges", lambda r: (r["range_start"] <= at) & (r["range_end"] > at))
    return rows.where(F.coalesce(F.col("_from") <= at, F.lit(False)) | F.coalesce(inside, F.lit(False))).drop("_day", "_ranges", "_from").select(*prints.columns)


_OPEN = 1 << 62


class GateState(StatefulProcessor):
    """The ranges of a contract as state, its prints judged against them as they come."""

    def __init__(self, columns: list[str]):
        self.columns = columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ranges = handle.getMapState("ranges", "start long", "finish long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        prints, changed = [], {}
        for frame in rows:
            is_range = frame["start_us"].notna()
            for start, finish in frame.loc[is_range, ["start_us", "finish_us"]].astype("int64").itertuples(index=False, name=None):
                changed[start] = min(finish, changed.get(start, finish))
            if not is_range.all():
                prints.append(frame[~is_range])
        for start, finish in changed.items():
            self.ranges.updateValue((start,), (finish,))
        if not prints:
            return
        held = np.array(sorted((s[0], f[0]) for s, f in self.ranges.iterator()), np.int64).reshape(-1, 2)
        reach = np.maximum.accumulate(held[:, 1])
        for frame in prints:
            at = frame["at_us"].to_numpy(np.int64)
            last = np.searchsorted(held[:, 0], at, side="right") - 1
            inside = (last >= 0) & (at < reach[np.maximum(last, 0)]) if len(held) else np.zeros(len(at), bool)
            if inside.any():
                yield frame.loc[inside, self.columns]

    def close(self) -> None:
        pass


def gate_with_changes(prints: DataFrame, coverage: DataFrame) -> DataFrame:
    """`print_gate` for a stream of prints and a stream of coverage: what has been reported by a print's batch decides.

    `coverage` brings ranges (contract, range_start, range_end) as they open
    (no end, or one in the year 9999) and once more as they close; a range is
    known by its start, and the newest end of it counts. A contract's ranges are
    its state, in RocksDB; ranges of a batch count before its prints do. A print
    that no range held when it came is not let through later.
    """
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    is_open = F.col("range_end").isNull() | (F.year("range_end") >= 9999)
    finish = F.when(is_open, F.lit(_OPEN)).otherwise(micros("range_end"))
    ranges = coverage.select(*CONTRACT, micros("range_start").alias("start_us"), finish.alias("finish_us"))
    both = prints.withColumn("at_us", micros("trade_time_utc")).unionByName(ranges, allowMissingColumns=True)
    return both.groupBy(*CONTRACT).transformWithStateInPandas(GateState(prints.columns), prints.schema, "Append", "None")


QUOTE = ["bid", "ask", "last", "volume", "last_at", "volume_at", "quote_time_utc", "received_at", "book_known", "trade_date"]
QUOTE_SCHEMA = (
    "venue string, contract_id string, bid double, ask double, last double, volume long, last_at timestamp_ntz, volume_at timestamp_ntz, "
    "quote_time_utc timestamp_ntz, received_at timestamp_ntz, book_known boolean, trade_date date"
)


def _carried(seen, seen_day, now, day) -> bool:
    return seen is not None and seen_day == day and abs((now - seen).total_seconds()) <= 60 * CARRY_MINUTES


def _fold_quote(held: dict | None, new: dict) -> dict | None:
    """One event into the quote of its contract; None while no book has been seen."""
    if held is None:
        return new if new["book_known"] else None
    out = dict(new)
    if not new["book_known"]:
        out["bid"], out["ask"] = held["bid"], held["ask"]
    for value, at in (("last", "last_at"), ("volume", "volume_at")):
        older = new[at] is not None and held[at] is not None and new[at] < held[at]
        if new[value] != 0 and not older:
            continue
        keep = held[value] != 0 and _carried(held[at], held["trade_date"], new["received_at"], new["trade_date"])
        out[value], out[at] = (held[value], held[at]) if keep else (0.0 if value == "last" else 0, None)
    times = [t for t in (held["quote_time_utc"], new["quote_time_utc"]) if t is not None]
    out["quote_time_utc"] = max(times) if times else None
    out["book_known"] = True
    return out


def _in_order(frame: pd.DataFrame) -> Iterator[dict]:
    for values in frame[QUOTE].itertuples(index=False, name=None):
        yield {k: None if v is None or v is pd.NaT or (isinstance(v, float) and v != v) else v for k, v in zip(QUOTE, values, strict=True)}


_FIELDS = (("last", "last_at"), ("volume", "volume_at"))
_NO_QUOTE = {"bid": None, "ask": None, "last": 0.0, "volume": 0, "last_at": None, "volume_at": None, "quote_time_utc": None, "book_known": True, "trade_date": None}


def _replay(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Fold events that are sorted by contract and order; one quote is held, whatever a contract's number of events."""
    key, held = None, None
    columns = ["venue", "contract_id", *QUOTE]
    for frame in frames:
        out = []
        for values in frame[["venue", "contract_id", "_from_first", *QUOTE]].itertuples(index=False, name=None):
            now, (from_first, *rest) = values[:2], values[2:]
            event = {k: None if v is None or v is pd.NaT or (isinstance(v, float) and v != v) else v for k, v in zip(QUOTE, rest, strict=True)}
            if now != key:
                if held:
                    out.append((*key, *[held[c] for c in QUOTE]))
                key, held = now, None if from_first else {**_NO_QUOTE, "received_at": event["received_at"]}
            held = _fold_quote(held, event) or held
        if out:
            yield pd.DataFrame(out, columns=columns)
    if held:
        yield pd.DataFrame([(*key, *[held[c] for c in QUOTE])], columns=columns)


def latest_quotes(events: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """The quote of each contract after all its events, in the order of (received_at, sequence), which should be unique in a contract.

    `stored` has the quotes that earlier events made; each counts as the first
    event of its contract, so events may be folded batch by batch.

    Aggregates alone decide nearly all contracts: the event of a contract's
    latest trade time is always taken, so only what comes after it matters, and
    without a later trade that is whether the value still carries. A contract
    that has later trades of earlier times is replayed from that event on. A
    contract whose book was never seen has no row.

    The events are read once for each of four steps. A step leaves one row a
    contract, which is stored, so that Spark knows its size and sends it to the
    events; events are neither sorted nor shuffled unless they are replayed.
    """
    keys = ["venue", "contract_id"]
    rows = events.select(*keys, *QUOTE, position(F.col("received_at"), F.col("sequence").cast("long")).alias("_order"))
    if stored is not None:
        rows = rows.unionByName(stored.select(*keys, *QUOTE, position(F.lit("0001-01-01").cast("timestamp_ntz"), F.lit(0)).alias("_order")))
    rows = rows.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("bid", "ask", "last")})
    first = written(rows.where("book_known").groupBy(*keys).agg(F.min("_order").alias("_first")), "quotes-first")
    traded = {value: ~F.col(value).eqNullSafe(F.lit(0)) for value, _ in _FIELDS}
    order, counts = F.col("_order"), {v: traded[v] | (F.col("_order") == F.col("_first")) for v, _ in _FIELDS}
    newest = lambda name, when: F.max_by(name, F.when(when, order))

    known = rows.join(first, keys).where("_order >= _first")
    ends = written(
        known.groupBy(*keys).agg(
            *[F.max(F.when(counts[v], F.col(at))).alias(f"_{v}_at") for v, at in _FIELDS],
            F.max(F.when(F.col("book_known"), order)).alias("_book_order"), newest("bid", F.col("book_known")).alias("_bid"), newest("ask", F.col("book_known")).alias("_ask"),
            F.max("quote_time_utc").alias("_quoted"), F.max_by("received_at", "_order").alias("_end_at"), F.max_by("trade_date", "_order").alias("_end_day"), F.min("_first").alias("_first"),
        ),
        "quotes-ends",
    )
    known = rows.join(ends, keys).where("_order >= _first")
    anchors = []
    for v, at in _FIELDS:
        here = counts[v] & F.col(at).eqNullSafe(F.col(f"_{v}_at"))
        anchors += [F.max(F.when(here, order)).alias(f"_{v}_order"), newest(v, here).alias(f"_{v}_value"), newest("trade_date", here).alias(f"_{v}_day")]
    anchored = written(known.groupBy(*keys).agg(*anchors).join(ends, keys), "quotes-anchors")
    known = rows.join(anchored, keys).where("_order >= _first")

    def after(value: str) -> list[Column]:
        later, held = order > F.col(f"_{value}_order"), F.col(f"_{value}_value")
        near = F.coalesce(F.abs(F.timestamp_diff("MICROSECOND", F.col(f"_{value}_at"), F.col("received_at"))) <= 60_000_000 * CARRY_MINUTES, F.lit(False))
        carries = near & F.col("trade_date").eqNullSafe(F.col(f"_{value}_day")) & ~held.eqNullSafe(F.lit(0))
        return [F.bool_and(~later | carries).alias(f"_{value}_kept"), F.bool_or(later & traded[value]).alias(f"_{value}_open")]

    found = written(known.groupBy(*keys).agg(*[c for v, _ in _FIELDS for c in after(v)]).join(anchored, keys), "quotes-found")
    unsure = F.col("_last_open") | F.col("_volume_open")
    held = lambda v, of, none: F.when(F.col(f"_{v}_kept"), F.col(f"_{v}_{of}")).otherwise(none)
    sure = found.where(~unsure).select(
        *keys, F.col("_bid").alias("bid"), F.col("_ask").alias("ask"), held("last", "value", F.lit(0.0)).alias("last"), held("volume", "value", F.lit(0)).cast("long").alias("volume"),
        held("last", "at", F.lit(None)).alias("last_at"), held("volume", "at", F.lit(None)).alias("volume_at"),
        F.col("_quoted").alias("quote_time_utc"), F.col("_end_at").alias("received_at"), F.lit(True).alias("book_known"), F.col("_end_day").alias("trade_date"),
    )
    start = found.where(unsure).select(*keys, "_first", "_quoted", F.least("_last_order", "_volume_order", "_book_order").alias("_start"))
    if start.isEmpty():
        return sure
    tail = rows.join(start, keys).where("_order >= _start").withColumn("_from_first", F.col("_start") == F.col("_first"))
    replayed = tail.repartition(*keys).sortWithinPartitions(*keys, "_order").drop("_start", "_first", "_quoted", "_order").mapInPandas(_replay, QUOTE_SCHEMA)
    replayed = replayed.join(start.select(*keys, "_quoted"), keys).withColumn("quote_time_utc", F.col("_quoted")).drop("_quoted")
    return sure.unionByName(replayed.select(sure.columns))


class QuoteState(StatefulProcessor):
    """The quote of a contract as state: events fold into it, a reconnect clears it, and a timer tells when it has gone stale."""

    SCHEMA = QUOTE_SCHEMA.removeprefix("venue string, contract_id string, ")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.quote = handle.getValueState("quote", self.SCHEMA)

    def _held(self) -> dict | None:
        if not self.quote.exists():
            return None
        return {c: None if v is pd.NaT else v for c, v in zip(QUOTE, self.quote.get(), strict=True)}

    def _row(self, key: tuple, held: dict | None, stale: bool) -> Iterator[pd.DataFrame]:
        values = [held[c] if held else None for c in QUOTE]
        yield pd.DataFrame([(*key, *values, stale)], columns=["venue", "contract_id", *QUOTE, "stale"]).astype({"last_at": "datetime64[us]", "volume_at": "datetime64[us]", "quote_time_utc": "datetime64[us]", "received_at": "datetime64[us]"})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held, cleared = self._held(), False
        frame = pd.concat(list(rows)).sort_values(["received_at", "sequence"], ignore_index=True)
        for is_clear, event in zip(frame["cleared"].tolist(), _in_order(frame), strict=True):
            held = None if is_clear else _fold_quote(held, event) or held
            cleared |= is_clear
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if held:
            self.quote.update(tuple(held[c] for c in QUOTE))
            self.handle.registerTimer(int(held["received_at"].replace(tzinfo=timezone.utc).timestamp() * 1000) + 1000 * STALE_SECONDS)
            yield from self._row(key, held, False)
        elif cleared:
            self.quote.clear()
            yield from self._row(key, None, True)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self._held()
        if held:
            yield from self._row(key, held, True)

    def close(self) -> None:
        pass


def stream_latest_quotes(events: DataFrame, delay: str = "0 seconds") -> DataFrame:
    """The same as a stream: each batch emits the quotes that it changed, and `stale`.

    `events` may have a boolean `cleared`: such a row (one for each contract after
    a reconnect) drops what is held, and the contract is emitted without values
    until its book is seen again. A quote is emitted once more, as stale, when
    the watermark (`delay` behind the newest event) has passed its last event by
    STALE_SECONDS. A batch's events of one contract are folded in one task; that
    state lies in RocksDB and may outgrow memory. Bulk history belongs in
    `upsert_quotes`, which folds by aggregates.
    """
    if "cleared" not in events.columns:
        events = events.withColumn("cleared", F.lit(False))
    events = events.withColumn("at", F.col("received_at").cast("timestamp")).withWatermark("at", delay)
    grouped = events.groupBy("venue", "contract_id")
    return grouped.transformWithStateInPandas(QuoteState(), f"{QUOTE_SCHEMA}, stale boolean", "Update", "EventTime")


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """Queries that are started inside keep their state in RocksDB, as keyed state with timers needs."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def drain_quotes(events: DataFrame, delay: str = "0 seconds") -> DataFrame:
    """Run `stream_latest_quotes` over all that is there; the last row of each contract."""
    spark = events.sparkSession
    path = scratch(spark, "quote-states")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")

    with rocksdb_state(spark):
        stream_latest_quotes(events, delay).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    schema = f"{QUOTE_SCHEMA}, stale boolean, batch int"
    rows = spark.read.schema(schema).parquet(f"{path}/rows")
    return rows.groupBy("venue", "contract_id").agg(F.max_by(F.struct(*QUOTE, "stale"), F.struct("batch", "stale")).alias("q")).select("venue", "contract_id", "q.*")


def merge_quotes(stored: DataFrame, flushed: DataFrame) -> DataFrame:
    """The quote table after a flush: a row replaces the stored one unless that was received later; an absent last or volume is carried."""
    keys = ["venue", "contract_id"]
    rows = stored.select(*keys, F.struct(*QUOTE).alias("old")).join(flushed.select(*keys, F.struct(*QUOTE).alias("new")), keys, "full")
    near = lambda at: (F.abs(F.timestamp_diff("SECOND", F.col(f"old.{at}"), F.col("new.received_at"))) <= 60 * CARRY_MINUTES) & F.col("old.trade_date").eqNullSafe(F.col("new.trade_date"))

    def field(value: str, at: str) -> tuple[Column, Column]:
        older = F.coalesce(F.col(f"new.{at}") < F.col(f"old.{at}"), F.lit(False))
        taken = (F.col(f"new.{value}") != 0) & ~older
        kept = (F.col(f"old.{value}") != 0) & F.coalesce(near(at), F.lit(False))
        zero = F.lit(0).cast("double" if value == "last" else "long")
        return F.when(taken, F.col(f"new.{value}")).when(kept, F.col(f"old.{value}")).otherwise(zero).alias(value), F.when(taken, F.col(f"new.{at}")).when(kept, F.col(f"old.{at}")).alias(at)

    last, last_at = field("last", "last_at")
    volume, volume_at = field("volume", "volume_at")
    book = F.col("new.book_known")
    merged = F.struct(
        F.when(book, F.col("new.bid")).otherwise(F.col("old.bid")).alias("bid"),
        F.when(book, F.col("new.ask")).otherwise(F.col("old.ask")).alias("ask"),
        last, volume, last_at, volume_at,
        F.greatest("old.quote_time_utc", "new.quote_time_utc").alias("quote_time_utc"),
        F.col("new.received_at").alias("received_at"),
        (F.col("old.book_known") | book).alias("book_known"),
        F.col("new.trade_date").alias("trade_date"),
    )
    newer = F.col("old").isNotNull() & (F.col("new").isNull() | (F.col("old.received_at") > F.col("new.received_at")))
    return rows.select(*keys, F.when(newer, F.col("old")).when(F.col("old").isNull(), F.col("new")).otherwise(merged).alias("q")).select(*keys, "q.*")


def upsert_quotes(events: DataFrame) -> DataFrame:
    """Flush a stream of quote events batch by batch into versions of the quote table; the last version is read.

    A batch starts from the quotes of the version before, so any cut of the
    events into batches, in their order, gives what all of them give at once.
    """
    spark = events.sparkSession
    path = scratch(spark, "quotes")
    done = []

    def write(batch: DataFrame, number: int) -> None:
        before = batch.sparkSession.read.schema(QUOTE_SCHEMA).parquet(f"{path}/version={number - 1}") if number else None
        latest_quotes(batch, before).select(*[c.split()[0] for c in QUOTE_SCHEMA.split(", ")]).write.mode("overwrite").parquet(f"{path}/version={number}")
        done.append(number)

    events.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(QUOTE_SCHEMA).parquet(f"{path}/version={max(done)}") if done else spark.createDataFrame([], QUOTE_SCHEMA)


def quote_read(quotes: DataFrame, fronts: DataFrame, now: Column, session_day: Column) -> DataFrame:
    """The quote of each asked instrument's front contract (instrument, contract_id): absent sides are NULL, last and volume only while they carry."""
    rows = fronts.join(quotes, "contract_id", "left")
    near = lambda at: (F.abs(F.timestamp_diff("SECOND", F.col(at), now)) <= 60 * CARRY_MINUTES) & F.col("trade_date").eqNullSafe(session_day)
    side = lambda c: F.when(F.col(c) != 0, F.col(c)).alias(c)
    status = F.when(F.col("contract_id").isNull(), "unknown_symbol").when(F.col("received_at").isNull(), "missing").otherwise("ok")
    age = F.timestamp_diff("SECOND", F.col("received_at"), now)
    return rows.select(
        "instrument", "contract_id", status.alias("status"), side("bid"), side("ask"),
        F.when((F.col("last") != 0) & near("last_at"), F.col("last")).alias("last"),
        F.when((F.col("volume") != 0) & near("volume_at"), F.col("volume")).alias("volume"),
        "quote_time_utc", "received_at", (age > STALE_SECONDS).alias("stale"),
    )


def stream_footprint(prints: DataFrame, minutes: int = 60, delay: str = "10 minutes") -> DataFrame:
    """Footprint cells of a stream; a bucket is final once the watermark has passed its end.

    Two aggregates would need two watermarks, so each cell carries the range of
    its contracts, and mixed buckets are dropped when the final cells are read.
    """
    rows = prints.where(F.col("direction").isin(1, 2) & (F.col("size") > 0)).withColumn("at", F.col("trade_time_utc").cast("timestamp")).withWatermark("at", delay)
    return (
        rows.groupBy(F.window("at", f"{minutes} minutes").alias("w"), "venue", "instrument", "price")
        .agg(
            F.sum(F.when(F.col("direction") == 1, F.col("size")).otherwise(0)).alias("buy_volume"),
            F.sum(F.when(F.col("direction") == 2, F.col("size")).otherwise(0)).alias("sell_volume"),
            F.min("contract_id").alias("low_contract"),
            F.max("contract_id").alias("high_contract"),
        )
        .select("venue", "instrument", F.col("w.start").cast("timestamp_ntz").alias("bucket_start"), "price", "buy_volume", "sell_volume", "low_contract", "high_contract")
    )


def single_contract_cells(cells: DataFrame) -> DataFrame:
    w = Window.partitionBy("venue", "instrument", "bucket_start")
    return cells.withColumn("_one", F.min("low_contract").over(w) == F.max("high_contract").over(w)).where("_one").drop("_one", "low_contract", "high_contract")



def recorder_health(ticks: DataFrame, coverage: DataFrame, leases: DataFrame, session: DataFrame, now: Column) -> DataFrame:
    """Per instrument and contract: lease state, last tick and its age, gaps of coverage in the session so far, and an overall verdict.

    leases: venue, instrument, heartbeat_at, expires_at, hub_connected,
    listening; session: venue, instrument, window_start, window_end. An open
    range counts only while the lease listens.
    """
    fresh = F.timestamp_diff("SECOND", F.col("heartbeat_at"), now) <= 60
    tick_fresh = F.coalesce(F.timestamp_diff("SECOND", F.col("last_tick"), now) <= 60, F.lit(False))
    state = (
        F.when(F.col("expires_at").isNull() | (F.col("expires_at") <= now), "stopped")
        .when(~F.coalesce("hub_connected", F.lit(False)), "reconnecting")
        .when(~fresh & ~tick_fresh, "reconnecting")
        .when(~F.coalesce("listening", F.lit(False)), "not listening")
        .otherwise("listening")
    )
    windows = session.withColumn("window_end", F.least(F.col("window_end"), now))
    keys = CONTRACT
    asked = windows.join(ticks.select(*CONTRACT), ["venue", "instrument"])
    live = coverage.join(leases.select("venue", "instrument", "listening"), ["venue", "instrument"], "left")
    live = live.where((F.col("range_end") < F.lit("9999-01-01").cast("timestamp_ntz")) | F.coalesce("listening", F.lit(False))).drop("listening")
    touching = overlapping(live, asked, keys, now)
    gaps = complement(touching, asked, keys).groupBy(*keys).agg(F.count("*").alias("gaps"), F.sum(F.timestamp_diff("SECOND", F.col("gap_start"), F.col("gap_end"))).alias("gap_seconds"))
    rows = ticks.join(leases, ["venue", "instrument"], "left").join(gaps, keys, "left").withColumn("state", state)
    overall = F.when(F.col("state") == "stopped", "unavailable").when((F.col("state") != "listening") | (F.coalesce("gaps", F.lit(0)) > 0), "degraded").otherwise("ok")
    return rows.select(*keys, "state", "last_tick", F.timestamp_diff("SECOND", F.col("last_tick"), now).alias("tick_age_seconds"), F.coalesce("gaps", F.lit(0)).cast("long").alias("gaps"), F.coalesce("gap_seconds", F.lit(0)).cast("long").alias("gap_seconds"), overall.alias("overall"))


