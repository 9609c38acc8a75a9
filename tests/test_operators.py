"""Operators on small frames with values worked out by hand."""

import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from barloom.functions import contracts as fc
from barloom.functions.market_time import Calendar, align_down, align_up
from barloom.operators import calendars, contracts, indicators, intervals, levels, maintenance, notes, series, tape
from barloom.streaming import tape as live

CAL = Calendar(holidays=("2026-09-07",), early_closes={"2026-08-21": 12 * 60})
BARS = "venue string, instrument string, resolution_minutes int, bucket_start timestamp_ntz, open double, high double, low double, close double, volume long, contract_id string"


def at(text):
    return datetime.fromisoformat(text)


def bars(spark, closes, start="2026-08-18T09:00", minutes=5, contract="CON.F.US.EP.U26", spread=1.0):
    contracts_ = contract if isinstance(contract, list) else [contract] * len(closes)
    rows = [("SIM", "ES", minutes, at(start) + timedelta(minutes=minutes * k), float(c), c + spread, c - spread, float(c), 10, i) for k, (c, i) in enumerate(zip(closes, contracts_, strict=True))]
    return spark.createDataFrame(rows, BARS)


def values(df, column="value"):
    return [r[column] for r in df.orderBy("bucket_start").collect()]


def test_grid_starts_in_year_one(spark):
    df = spark.createDataFrame([(at("2026-08-18T09:00"),)], "t timestamp_ntz")
    r = df.select(align_down("t", 660).alias("d"), align_up("t", 660).alias("u"), align_up("t", 60).alias("same")).first()
    assert (r["d"], r["u"], r["same"]) == (at("2026-08-18T08:00"), at("2026-08-18T19:00"), at("2026-08-18T09:00"))


@pytest.mark.parametrize(
    "instant, want",
    [
        ("2026-08-18T20:59", date(2026, 8, 18)),  # 15:59 Chicago
        ("2026-08-18T21:00", None),  # the maintenance hour
        ("2026-08-18T22:00", date(2026, 8, 19)),
        ("2026-08-21T22:00", None),  # Friday evening
        ("2026-08-23T22:00", date(2026, 8, 24)),  # Sunday evening
        ("2026-09-07T15:00", None),  # holiday
    ],
)
def test_trade_dates(spark, instant, want):
    df = spark.createDataFrame([(at(instant),)], "t timestamp_ntz")
    assert df.select(CAL.trade_date("t").alias("d")).first()["d"] == want


def test_expected_buckets_ignore_early_closes_and_sessions_honour_them(spark):
    df = spark.createDataFrame([(at("2026-08-21T18:00"),), (at("2026-08-21T20:30"),)], "t timestamp_ntz")
    assert [r[0] for r in df.select(CAL.is_expected("t", 60)).collect()] == [True, False]
    s = calendars.product_sessions(spark.createDataFrame([(date(2026, 8, 21),)], "trade_date date"), CAL).first()
    assert (s["open_utc"], s["close_utc"]) == (at("2026-08-20T22:00"), at("2026-08-21T17:00"))


def test_contract_ids(spark):
    df = spark.createDataFrame([("CON.F.US.EP.H24",), ("H24",), ("CON.F.US.EP.A24",), (None,), ("",)], "c string")
    assert [r[0] for r in df.select(fc.expiry_rank("c")).collect()] == [2024 * 12 + 3, 2024 * 12 + 3, None, None, None]
    assert [r[0] for r in df.select(fc.has_product("c", F.lit("EP"))).collect()] == [True, False, True, False, False]


def test_account_stages(spark):
    names = ["PRAC-1", " 50ktc-V2-9", "EXPRESS-1", "PRACTICEJUL3", "EXPRESSJUL3", "S1JUL4", "other", "", None, "KTC-1"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r[0] for r in df.select(fc.account_stage("n")).collect()] == ["practice", "evaluation", "funded", "practice", "funded", "evaluation", "unknown", "unknown", "unknown", "unknown"]


def test_runs_keep_unknown_contracts_apart(spark):
    df = bars(spark, range(6), contract=["A", "A", None, None, "A", "B"])
    got = series.contract_segments(df).orderBy("first_bucket").collect()
    assert [(r["contract_id"], r["bars"]) for r in got] == [("A", 2), (None, 2), ("A", 1), ("B", 1)]
    assert series.newest_segment(df).count() == 1


def test_averages_by_hand(spark):
    df = bars(spark, [1, 2, 3, 4, 10])
    assert values(indicators.sma(df, 3)) == [None, None, 2.0, 3.0, 17 / 3]
    assert values(indicators.ema(df, 3)) == [None, None, 2.0, 3.0, 6.5]
    assert values(indicators.vwap_rolling(df, 2))[1:] == pytest.approx([1.5, 2.5, 3.5, 7.0])


def test_indicators_restart_at_a_roll(spark):
    df = bars(spark, [1, 2, 3, 4, 5, 6], contract=["A"] * 3 + ["B"] * 3)
    assert values(indicators.sma(df, 2)) == [None, 1.5, 2.5, None, 4.5, 5.5]
    assert values(indicators.ema(df, 3)) == [None, None, 2.0, None, None, 5.0]


def test_average_range_and_strength(spark):
    df = bars(spark, [10, 12, 11, 15], spread=1.0)
    # true ranges 3, 2, 5 after the first bar
    assert values(indicators.atr(df, 2)) == [None, None, 2.5, 3.75]
    assert values(indicators.rsi(df, 2)) == [None, None, pytest.approx(100 * 2 / 3), pytest.approx(100 * 2.5 / 2.75)]
    assert values(indicators.rsi(bars(spark, [5, 5, 5, 5]), 2)) == [None, None, 50.0, 50.0]
    assert values(indicators.rsi(bars(spark, [1, 2, 3]), 2)) == [None, None, 100.0]


def test_a_long_series_in_small_batches_is_one_recurrence(spark):
    n = 1000
    df = bars(spark, [float((k * 37) % 101) for k in range(n)])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        got = values(indicators.ema(df, 9))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want, y = [], None
    for k in range(n):
        c = float((k * 37) % 101)
        if k == 8:
            y = sum(float((j * 37) % 101) for j in range(9)) / 9
        elif k > 8:
            y += 0.2 * (c - y)
        want.append(y)
    assert got[:8] == [None] * 8 and got[8:] == pytest.approx(want[8:])


def test_footprint_drops_mixed_buckets(spark):
    rows = [("SIM", "ES", c, at(t), k, p, s, d) for k, (c, t, p, s, d) in enumerate([("A", "2026-08-18T09:01", 1.0, 5, 1), ("A", "2026-08-18T09:02", 1.0, 3, 2), ("B", "2026-08-18T10:01", 1.0, 5, 1), ("A", "2026-08-18T10:02", 1.0, 5, 1), ("A", "2026-08-18T11:00", 1.0, 5, 1), ("B", "2026-08-18T11:10", 1.0, 5, 0), ("B", "2026-08-18T11:20", 1.0, 0, 1)])]
    prints = spark.createDataFrame(rows, "venue string, instrument string, contract_id string, trade_time_utc timestamp_ntz, sequence long, price double, size long, direction int")
    got = tape.footprint(prints, 60).orderBy("bucket_start").collect()
    assert [(r["bucket_start"].hour, r["buy_volume"], r["sell_volume"]) for r in got] == [(9, 5, 3), (11, 5, 0)]


@pytest.mark.parametrize(
    "volumes, want",
    [
        ([1, 10, 1], (1, 1)),
        ([5, 10, 5, 5], (1, 3)),  # one level with 5 below, two with 10 above: above, and 70 % is reached
        ([4, 4, 11, 4, 4], (0, 2)),  # equal sides go below
        ([0, 0], (0, 0)),
        ([7], (0, 0)),
    ],
)
def test_value_area(spark, volumes, want):
    ladder = spark.createDataFrame([("k", float(p), v) for p, v in enumerate(volumes)], "k string, price double, volume long")
    r = tape.value_area(ladder, ["k"]).first()
    assert (r["val"], r["vah"]) == tuple(map(float, want))


def test_interval_union_and_complement(spark):
    t = lambda h: at(f"2026-08-18T{h:02d}:00")
    rows = [("x", t(1), t(2)), ("x", t(2), t(3)), ("x", t(5), t(7)), ("x", t(6), t(6)), ("x", t(4), t(4))]
    df = spark.createDataFrame(rows, "k string, range_start timestamp_ntz, range_end timestamp_ntz")
    assert sorted((r["range_start"].hour, r["range_end"].hour) for r in intervals.union(df, ["k"]).collect()) == [(1, 3), (5, 7)]
    w = spark.createDataFrame([("x", t(0), t(8)), ("y", t(0), t(8))], "k string, window_start timestamp_ntz, window_end timestamp_ntz")
    got = intervals.complement(df.join(w, "k"), w, ["k"]).collect()
    assert sorted((r["k"], r["gap_start"].hour, r["gap_end"].hour) for r in got) == [("x", 0, 1), ("x", 3, 5), ("x", 7, 8), ("y", 0, 8)]


def test_gaps_break_at_held_buckets_only(spark):
    df = bars(spark, [1, 2], start="2026-08-18T09:00", minutes=60)
    grid = spark.createDataFrame([(at("2026-08-18T09:00"),), (at("2026-08-18T11:00"),), (at("2026-08-18T20:00"),), (at("2026-08-18T22:00"),)], "bucket_start timestamp_ntz")
    got = intervals.bar_gaps(df, grid, 60).collect()
    assert [(r["range_start"].hour, r["range_end"].hour, r["buckets"]) for r in got] == [(11, 23, 3)]


def test_zones_merge_and_are_capped(spark):
    z = lambda b, t, s, k="Support": ("v", "ES", 5, float(b), float(t), k, at("2026-08-18T09:00"), 1, float(s), None)
    df = spark.createDataFrame([z(1, 2, 1), z(2, 3, 5, "Resistance"), z(4, 5, 2)], "venue string, instrument string, resolution_minutes int, bottom double, top double, kind string, formed_at timestamp_ntz, touches long, significance double, period string")
    got = levels.merge_zones(df, levels.KEYS).orderBy("bottom").collect()
    assert [(r["bottom"], r["top"], r["kind"], r["touches"]) for r in got] == [(1.0, 3.0, "Resistance", 2), (4.0, 5.0, "Support", 1)]
    assert levels.level_cap(df, levels.KEYS, 2).count() == 2
    assert levels.merge_zones(df.limit(0), levels.KEYS).count() == 0


def test_a_second_projection_changes_nothing(spark):
    df = bars(spark, [float(k % 7) for k in range(60)])
    made = maintenance.rounded(indicators.catalogue(df, CAL, [("sma", 5), ("ema", 5)]))
    assert maintenance.project(made, made).count() == 0
    assert maintenance.reconcile(made, made, df, [("sma", 5), ("ema", 5)]).count() == 0
    _, changed = maintenance.upsert(df, df, [*series.SERIES, "bucket_start"], ["close", "contract_id"])
    assert changed.count() == 0
    with pytest.raises(ValueError):
        indicators.catalogue(df, CAL, [("sma", 5), ("sma", 5)])


def test_candidates_wrap_the_year(spark):
    d = spark.createDataFrame([(date(2026, 11, 3),), (date(2026, 12, 31),)], "trade_date date")
    got = contracts.candidates(d, "HMUZ", 3).orderBy("trade_date", "position").collect()
    assert [r["expiry"] for r in got] == ["Z26", "H27", "M27"] * 2


def test_notes_as_stored(spark):
    rows = [(1, " es ", None, "  hi  "), (2, "zz", "IDEA", "x"), (3, None, " ", "   ")]
    df = spark.createDataFrame([(*r, at("2026-01-01")) for r in rows], "id long, instrument string, kind string, text string, recorded_at timestamp_ntz")
    known = spark.createDataFrame([("ES",)], "symbol string")
    got = notes.append(df, known).orderBy("id").collect()
    assert [(r["id"], r["instrument"], r["kind"], r["text"], r["tags"]) for r in got] == [(1, "ES", "note", "hi", []), (2, None, "idea", "x", [])]


def quote(at_, bid=0.0, ask=0.0, last=0.0, volume=0, book=True, day=date(2026, 8, 18), n=0):
    return ("SIM", "C", n, bid, ask, last, volume, at_ if last else None, at_ if volume else None, at_ if book else None, at_, book, day)


QUOTES = "venue string, contract_id string, sequence long, bid double, ask double, last double, volume long, last_at timestamp_ntz, volume_at timestamp_ntz, quote_time_utc timestamp_ntz, received_at timestamp_ntz, book_known boolean, trade_date date"


def test_quotes_carry_for_half_an_hour(spark):
    t = at("2026-08-18T15:00")
    m = lambda k: t + timedelta(minutes=k)
    first = [quote(m(0), last=9.0, volume=3, book=False, n=1), quote(m(1), 1.0, 2.0, n=2), quote(m(2), last=5.0, volume=7, book=False, n=3)]
    for later, last in ((20, 5.0), (40, 0.0)):
        df = spark.createDataFrame([*first, quote(m(later), 0.0, 3.0, n=4)], QUOTES)
        r = live.latest_quotes(df).first()
        assert (r["bid"], r["ask"], r["last"], r["volume"]) == (0.0, 3.0, last, 7 if last else 0)
    only_trades = spark.createDataFrame([first[0]], QUOTES)
    assert live.latest_quotes(only_trades).count() == 0


def test_quotes_of_any_order_equal_a_plain_fold(spark):
    draw = random.Random(5)
    t, rows_ = at("2026-08-18T15:00"), []
    for contract in range(300):
        for n in range(draw.randint(1, 14)):
            received = t + timedelta(minutes=draw.randint(0, 6) * 11, seconds=n)
            trade, sized = draw.random() < 0.4, draw.random() < 0.4
            back = lambda: None if draw.random() < 0.1 else received - timedelta(minutes=draw.choice([0, 0, 0, 5, 25, 60]))
            book = draw.random() < 0.6
            rows_.append((
                "SIM", f"C{contract}", n, float(n) if book else None, float(n + 1) if book else None, draw.choice([9.5, None]) if trade else 0.0, n + 3 if sized else 0,
                back() if trade or draw.random() < 0.2 else None, back() if sized or draw.random() < 0.2 else None, back(), received, book, date(2026, 8, 18 + (received > t + timedelta(minutes=draw.choice([50, 500])))),
            ))
    names = [c.split()[0] for c in QUOTES.split(", ")]
    want = {}
    for contract in {r[1] for r in rows_}:
        held = None
        for r in sorted((r for r in rows_ if r[1] == contract), key=lambda r: (r[10], r[2])):
            held = live._fold_quote(held, dict(zip(names, r, strict=True))) or held
        if held:
            want[contract] = tuple(held[c] for c in live.QUOTE)
    found = live.latest_quotes(spark.createDataFrame(rows_, QUOTES)).collect()
    assert len(found) == len(want) > 200
    assert {r["contract_id"]: tuple(r[c] for c in live.QUOTE) for r in found} == want


def in_files(spark, tmp_path, name, batches, schema):
    """A stream that brings each of the batches of rows as one file."""
    import os
    import time

    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"file://{tmp_path}/{name}/{k:03d}")
        for f in (tmp_path / name / f"{k:03d}").iterdir():
            os.utime(f, (time.time() - 1000 + k, time.time() - 1000 + k))
    return spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/{name}")


def quote_rows(draw, contracts, events):
    t, out = at("2026-08-18T15:00"), []
    for n in range(events):
        received, trade = t + timedelta(minutes=draw.randint(0, 4), seconds=n), draw.random() < 0.5
        t = received
        row = quote(received, 0.0 if trade else float(n), 0.0 if trade else n + 1.0, 10.5 + n if trade else 0.0, 7 + n if trade and draw.random() < 0.8 else 0, not trade, n=n)
        out.append((row[0], f"C{draw.randrange(contracts)}", *row[2:]))
    return out


def plain_fold(rows):
    names, held = [c.split()[0] for c in QUOTES.split(", ")], {}
    for r in sorted(rows, key=lambda r: (r[10], r[2])):
        if (new := live._fold_quote(held.get(r[1]), dict(zip(names, r, strict=True)))) is not None:
            held[r[1]] = new
    return {c: tuple(q[k] for k in live.QUOTE) for c, q in held.items()}


@pytest.mark.parametrize("seed", range(4))
def test_any_cut_of_quote_events_gives_the_batch_answer(spark, tmp_path, seed):
    draw = random.Random(seed)
    # the least case first: a quote, a trade, a quote, each a file
    rows = quote_rows(draw, 4, 40) if seed else [quote(at("2026-08-18T15:00"), 1.0, 2.0), quote(at("2026-08-18T15:01"), last=10.5, volume=7, book=False, n=1), quote(at("2026-08-18T15:02"), 1.5, 2.5, n=2)]
    cuts = sorted(draw.sample(range(1, len(rows)), 4 if seed else 2))
    batches = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True)]
    stream = in_files(spark, tmp_path, "quotes", batches, QUOTES)
    want = plain_fold(rows)
    values = lambda df: {r["contract_id"]: tuple(r[c] for c in live.QUOTE) for r in df.collect()}
    assert values(live.upsert_quotes(stream)) == want == values(live.latest_quotes(spark.createDataFrame(rows, QUOTES)))
    if seed < 2:  # each batch of keyed state starts Python workers of its own
        assert values(live.drain_quotes(stream)) == want


def test_many_cuts_folded_by_aggregates(spark):
    """The later events on the quotes that the earlier ones made, for twenty cuts, each of contracts of its own."""
    early, late, want = [], [], {}
    for seed in range(20):
        draw = random.Random(100 + seed)
        rows = [(r[0], f"{r[1]}-{seed}", *r[2:]) for r in quote_rows(draw, 3, 25)]
        cut = draw.randrange(1, len(rows))
        early, late, want = early + rows[:cut], late + rows[cut:], want | plain_fold(rows)
    stored = live.latest_quotes(spark.createDataFrame(early, QUOTES))
    got = live.latest_quotes(spark.createDataFrame(late, QUOTES), stored).collect()
    assert {r["contract_id"]: tuple(r[c] for c in live.QUOTE) for r in got} == want


def test_a_quote_goes_stale_by_a_timer_and_is_cleared_by_a_reconnect(spark, tmp_path):
    t = at("2026-08-18T15:00")
    a = lambda s, *rest, **more: (*quote(t + timedelta(seconds=s), *rest, **more), False)
    other = lambda s: (*("SIM", "D"), *quote(t + timedelta(seconds=s), 1.0, 2.0)[2:], False)
    gone = (*quote(t + timedelta(seconds=100), book=False), True)
    batches = [[a(0, 1.0, 2.0), other(0)], [other(60)], [gone, other(101)], [a(102, last=9.0, volume=1, book=False)], [a(103, 5.0, 6.0)]]
    for n in (2, 4, 5):
        folder = tmp_path / str(n)
        found = {r["contract_id"]: r for r in live.drain_quotes(in_files(spark, folder, "q", batches[:n], f"{QUOTES}, cleared boolean")).collect()}
        c = found["C"]
        if n == 2:
            assert (c["bid"], c["stale"]) == (1.0, True)
        elif n < 5:
            assert c["bid"] is None and c["stale"]  # no book since the reconnect
        else:
            assert (c["bid"], c["last"], c["volume"], c["book_known"]) == (5.0, 0.0, 0, True)


def test_a_gate_follows_coverage_that_changes(spark, tmp_path):
    from datetime import datetime

    m = lambda k: datetime(2024, 3, 1, 10) + timedelta(minutes=k)
    end = datetime(9999, 12, 31)
    ranges = [[("S", "i", "A", m(0), end)], [("S", "i", "B", m(10), None), ("S", "i", "A", m(0), m(15))], [("S", "i", "A", m(30), end), ("S", "i", "A", m(30), m(40))]]
    prints = [[("S", "i", "A", m(1), 1), ("S", "i", "B", m(1), 2)], [("S", "i", "A", m(12), 3), ("S", "i", "A", m(16), 4), ("S", "i", "B", m(11), 5), ("S", "i", "C", m(11), 6)], [("S", "i", "A", m(14), 7), ("S", "i", "A", m(35), 8), ("S", "i", "A", m(41), 9), ("S", "i", "B", m(500), 10)]]
    p_schema, r_schema = "venue string, instrument string, contract_id string, trade_time_utc timestamp_ntz, n long", "venue string, instrument string, contract_id string, range_start timestamp_ntz, range_end timestamp_ntz"
    passed = live.drain(live.gate_with_changes(in_files(spark, tmp_path, "p", prints, p_schema), in_files(spark, tmp_path, "r", ranges, r_schema)), "gate")
    final = [("S", "i", "A", m(0), m(15)), ("S", "i", "A", m(30), m(40)), ("S", "i", "B", m(10), None)]
    batch = live.print_gate(spark.createDataFrame([r for b in prints for r in b], p_schema), spark.createDataFrame(final, r_schema))
    assert sorted(r["n"] for r in passed.collect()) == sorted(r["n"] for r in batch.collect()) == [1, 3, 5, 7, 8, 10]


def test_a_gate_reaches_as_far_as_its_ranges(spark):
    from barloom.streaming import tape as live

    prints = spark.sql("""SELECT 'SIM' venue, 'ES' instrument, c contract_id, t trade_time_utc, 1 seq FROM VALUES
        ('A', timestamp_ntz'2024-03-20 01:00:00'), ('A', timestamp_ntz'2023-12-31 01:00:00'), ('A', timestamp_ntz'2150-01-01 01:00:00'),
        ('B', timestamp_ntz'2024-04-09 01:00:00'), ('B', timestamp_ntz'2024-07-20 01:00:00'), ('C', timestamp_ntz'2024-01-02 01:00:00') AS x(c, t)""")
    ranges = spark.sql("""SELECT 'SIM' venue, 'ES' instrument, c contract_id, s range_start, e range_end FROM VALUES
        ('A', timestamp_ntz'2024-01-01', timestamp_ntz'9999-12-31'), ('A', timestamp_ntz'2024-02-01', timestamp_ntz'2024-03-01'),
        ('B', timestamp_ntz'2024-01-01', timestamp_ntz'2024-07-01'), ('C', timestamp_ntz'2024-01-02', timestamp_ntz'2024-01-02') AS x(c, s, e)""")
    passed = live.print_gate(prints, ranges)
    assert passed.columns == prints.columns
    assert sorted((r["contract_id"], r["trade_time_utc"].isoformat()[:10]) for r in passed.collect()) == [("A", "2024-03-20"), ("A", "2150-01-01"), ("B", "2024-04-09")]


def test_an_as_of_read_reaches_back_to_any_value(spark):
    from barloom.operators import asof

    key = "'SIM' venue, 'ES' instrument, 60 resolution_minutes"
    values = spark.sql(f"SELECT {key}, 'sma' indicator, 20 period, t bucket_start, v value FROM VALUES (timestamp_ntz'2024-01-01 05:00:00', 1.0D), (timestamp_ntz'2024-03-01 05:00:00', 2.0D) AS x(t, v)")
    bars = values.selectExpr("venue", "instrument", "resolution_minutes", "bucket_start", "'c' contract_id")
    asks = spark.sql(f"SELECT {key}, a ask_id, 'sma' indicator, 20 period, t as_of_utc FROM VALUES (1, timestamp_ntz'2024-01-10'), (2, timestamp_ntz'2024-02-20'), (3, timestamp_ntz'2025-07-01'), (4, timestamp_ntz'2023-01-01'), (5, timestamp_ntz'2024-01-01 06:00:00') AS x(a, t)")
    assert sorted((r["ask_id"], r["value"]) for r in asof.values_asof(asks, values, bars).collect()) == [(1, 1.0), (2, 1.0), (3, 2.0), (5, 1.0)]


def test_a_smoothing_ends_at_the_first_hole_after_its_seed(spark):
    from barloom.operators.recurrence import Smooth, scan

    xs = [None, 1.0, None, 2.0, 3.0, None, None, 4.0, 5.0]
    rows = spark.createDataFrame([("s", k, x) for k, x in enumerate(xs)], "key string, at long, x double").repartition(1)
    got = [r["y"] for r in sorted(scan(rows, ["key"], "at", [Smooth("y", "x", 2, 0.5)]).collect(), key=lambda r: r["at"])]
    assert [None if y is None or y != y else y for y in got] == [None, None, None, 1.5, 2.25, None, None, None, None]


def test_sequences_count_on_from_batch_to_batch(spark, tmp_path):
    from barloom.streaming import tape as live

    schema = "venue string, instrument string, contract_id string, trade_time_utc timestamp_ntz, price double, size long, direction int, source_id long"
    for k in range(3):
        rows = spark.range(4).selectExpr("'SIM' venue", "'ES' instrument", f"concat('C', id % {k + 1}) contract_id", f"timestampadd(MINUTE, cast(id + 10 * {k} as int), timestamp_ntz'2024-01-01') trade_time_utc", "1.0D price", "1L size", "1 direction", f"id + 10 * {k} source_id")
        rows.coalesce(1).write.parquet(f"file://{tmp_path}/in/{k}")
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    got = [(r["contract_id"], r["sequence"]) for r in live.stream_tape(stream).collect()]
    counts = {c: sum(x == c for x, _ in got) for c in ("C0", "C1", "C2")}
    assert len(got) == 12 and sorted(got) == sorted((c, n) for c, most in counts.items() for n in range(1, most + 1))


@pytest.mark.parametrize("seed", range(2))
def test_late_rows_go_aside_and_none_is_lost(spark, tmp_path, seed):
    """Rows of any order in any batches, nulls and repeated rows among them, against a plain loop; the stream stops and goes on."""
    from datetime import datetime

    draw = random.Random(seed)
    batches = [[("S", "i", draw.choice(["A", "B", None]), draw.choice([None, datetime(2024, 3, 1) + timedelta(minutes=draw.randrange(60 * 24 * 4))]) if draw.random() < 0.2 else datetime(2024, 3, 1) + timedelta(minutes=draw.randrange(60 * 24 * (b + 1))), b, draw.randrange(3)) for _ in range(12)] for b in range(4)]
    schema = "venue string, instrument string, contract_id string, trade_time_utc timestamp_ntz, n long, size long"
    newest, want = {}, {"main": [], "late": []}
    for batch in batches:
        for row in batch:
            t, mark = row[3], newest.get(row[2])
            closed = t is not None and mark is not None and datetime(t.year, t.month, t.day) + timedelta(days=1, minutes=10) <= mark
            want["late" if closed else "main"].append(row)
        for row in batch:
            if row[3] is not None and (row[2] not in newest or newest[row[2]] < row[3]):
                newest[row[2]] = row[3]
    out, source = f"file://{tmp_path}/out", spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1)
    for upto in (2, 4):  # the second call goes on behind the first
        in_files(spark, tmp_path, f"p/{upto}", batches[upto - 2 : upto], schema)
        main, late = live.stream_days(source.parquet(f"file://{tmp_path}/p"), out)
    plain = lambda df: sorted(repr(tuple(r[c] for c in ("venue", "instrument", "contract_id", "trade_time_utc", "n", "size"))) for r in df.collect())
    assert plain(main) == sorted(map(repr, want["main"])) and plain(late) == sorted(map(repr, want["late"])) and want["late"]
    assert sum(r["late"] for r in live.days_to_export(late).collect()) == len(want["late"])
    (tmp_path / "none").mkdir()
    main, late = live.stream_days(spark.readStream.schema(schema).parquet(f"file://{tmp_path}/none"), f"file://{tmp_path}/empty")
    assert main.count() == late.count() == 0
    with pytest.raises(ValueError):
        live.stream_days(source.parquet(f"file://{tmp_path}/p").withColumn("late", F.lit(True)), out)


@pytest.mark.parametrize("block", [1, 7, 1000])
def test_neighbours_are_the_same_in_any_blocks_of_queries(spark, block):
    draw = random.Random(3)
    rows_ = [(k, "m1", [float(draw.randint(-3, 3)) for _ in range(4)] if k % 9 else [1.0, 2.0, 0.0, 1.0]) for k in range(60)] + [(99, "m2", [1.0, 0.0, 0.0, 0.0])]
    rows_ = [r for r in rows_ if any(r[2])]
    vectors = spark.createDataFrame(rows_, "owner_id long, model string, embedding array<float>")
    asked = vectors.where("owner_id % 10 = 0 or owner_id = 9").selectExpr("owner_id AS query_id", "embedding AS query")
    cosine = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / (sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5
    of_model = [r for r in rows_ if r[1] == "m1"]
    want = set()
    for q, _, x in (r for r in of_model if r[0] % 10 == 0 or r[0] == 9):
        best = sorted(of_model, key=lambda r: (-cosine(r[2], x), r[0]))[:3]
        want |= {(q, rank + 1, r[0]) for rank, r in enumerate(best)}
    found = notes.semantic_topk(vectors, asked, 3, "m1", block=block).collect()
    assert {(r["query_id"], r["rank"], r["owner_id"]) for r in found} == want and len(found) == len(want)


def test_a_method_report_tells_refusals_from_methods_without_levels(spark):
    named = [("v", "in", 60), ("v", "out", 60), ("v", "late", 60)]
    # hours of a Wednesday's session; one series also holds a bar of the hour after the close, one only has narrowed tape
    hours = {"in": ["15:00", "16:00"], "out": ["15:00", "22:00"], "late": ["15:00"]}
    bars = spark.createDataFrame([(*s, at(f"2024-01-24T{h}")) for s in named for h in hours[s[1]]], "venue string, instrument string, resolution_minutes int, bucket_start timestamp_ntz")
    dates = spark.sql("SELECT date'2024-01-24' trade_date")
    overhang = calendars.series_overhangs(bars, dates, CAL, [60])
    assert {r["instrument"]: r["overhangs"] for r in overhang.collect()} == {"in": False, "out": True, "late": False}
    tape = spark.createDataFrame([("v", "in", False), ("v", "late", True)], "venue string, instrument string, narrowed boolean")
    methods = ("swing", "session", "pivot-classic", "volume-poc")
    refused = levels.refusals(overhang, tape, methods)
    assert {(r["instrument"], r["method"], r["reason"]) for r in refused.collect()} == {
        ("out", "session", levels.OVERHANG), ("out", "pivot-classic", levels.OVERHANG), ("out", "volume-poc", levels.NO_TAPE), ("late", "volume-poc", levels.NARROWED),
    }
    zone = lambda name, method, bottom: ("v", name, 60, method, bottom, bottom + 1.0)
    zones = spark.createDataFrame([zone("in", "swing", 4.0), zone("in", "swing", 2.0), zone("in", "session", 2.0), zone("out", "session", 1.0), zone("late", "volume-poc", 1.0), zone("out", "swing", 9.0)], "venue string, instrument string, resolution_minutes int, method string, bottom double, top double")
    options = levels.Options(max_levels=2, weights={"Swing": 2.0})
    report = {(r["instrument"], r["method"]): (r["family"], r["weight"], r["zones"], r["capped"], r["absence"]) for r in levels.method_report(bars, zones, refused, methods, options).collect()}
    assert len(report) == 12
    assert report["in", "swing"] == ("swing", 2.0, 2, True, None) and report["in", "session"] == ("session", 1.0, 1, False, None)
    assert report["in", "pivot-classic"] == ("pivot", 1.0, 0, False, levels.NO_LEVELS) == report["late", "pivot-classic"]
    assert report["out", "session"][2:] == (0, False, levels.OVERHANG) and report["out", "volume-poc"][4] == levels.NO_TAPE and report["late", "volume-poc"][2:] == (0, False, levels.NARROWED)
    kept = levels.in_order(levels.allowed(zones, refused)).collect()
    assert sorted((r["instrument"], r["position"], r["method"], r["midpoint"]) for r in kept) == [("in", 1, "session", 2.5), ("in", 2, "swing", 2.5), ("in", 3, "swing", 4.5), ("out", 1, "swing", 9.5)]
    assert levels.refusals(overhang, tape, ("swing",)).count() == 0
