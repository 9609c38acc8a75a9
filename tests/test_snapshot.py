"""Snapshots: what a window of bars spans, and what each indicator says across a roll."""

import datetime

import pytest
from pyspark.sql import functions as F

from barloom.functions.market_time import SAMPLE_CALENDAR as CAL
from barloom.operators import indicators, levels, snapshot

SERIES = "venue string, instrument string, resolution_minutes int"
BAR = SERIES + ", bucket_start timestamp_ntz, open double, high double, low double, close double, volume long, contract_id string"


def made(spark, series):
    """Hourly bars from a Wednesday's open session on; `series` gives each instrument its contracts."""
    first = datetime.datetime(2024, 1, 24, 0)
    rows = []
    for name, contracts in series.items():
        for k, c in enumerate(contracts):
            close = 100.0 + 3 * ((k * 7) % 11)
            rows.append(("v", name, 60, first + datetime.timedelta(hours=k), close, close + 1, close - 1, close, 10 + k, c))
    return spark.createDataFrame(rows, BAR)


def test_spans_of_windows(spark):
    bars = made(spark, {"one": ["A", "A"], "roll": ["A", "B"], "hole": ["A", None, "A"], "both": ["A", None, "B"], "none": [None]})
    got = {r["instrument"]: (r["bars"], r["contracts"], r["span"]) for r in snapshot.window_of(bars).collect()}
    assert got == {"one": (2, "A", "SingleContract"), "roll": (2, "A,B", "SpansRoll"), "hole": (3, "A", "Unknown"), "both": (3, "A,B", "SpansRoll"), "none": (1, "", "Unknown")}


def snapshot_of(spark, bars, **more):
    dates = spark.sql("SELECT explode(sequence(date'2024-01-10', date'2024-02-10')) trade_date")
    nothing = lambda schema: spark.createDataFrame([], schema)
    tape = nothing("venue string, instrument string, narrowed boolean")
    ladder, area = nothing("venue string, instrument string, price double, volume long"), nothing("venue string, instrument string, poc double, vah double, val double, total_volume long, levels long")
    options = levels.Options(left=2, right=2, source="HighLow", min_significance=0.0, width_percent=1e6)
    return snapshot.Snapshot(bars, indicators.catalogue(bars, CAL), dates, CAL, F.lit("2024-01-24 15:00:00").cast("timestamp_ntz"), tape, ladder, area, options, **more)


def test_readings_keep_their_own_bucket_and_contract_after_a_roll(spark):
    bars = made(spark, {"X": ["A"] * 40 + ["B"] * 10, "Y": ["A"] * 3})
    got = {(r["instrument"], r["indicator"]): r for r in snapshot_of(spark, bars).readings().collect()}
    assert len(got) == 2 * len(indicators.CATALOGUE)
    last = {k: bars.where(f"instrument = '{k}'").agg(F.max("bucket_start")).first()[0] for k in "XY"}
    # ten bars of B: no average of twenty yet, so A's newest one stands, ten hours older
    assert got["X", "sma"]["contract_id"] == "A" and got["X", "sma"]["bucket_start"] == last["X"] - datetime.timedelta(hours=10)
    assert got["X", "vwap"]["contract_id"] == "B" and got["X", "vwap"]["bucket_start"] == last["X"]
    # three bars: there is a row for what cannot be measured
    assert (got["Y", "sma"]["value"], got["Y", "sma"]["bucket_start"], got["Y", "sma"]["contract_id"]) == (None, None, None)


def test_levels_look_further_than_the_bars_shown_and_stop_at_a_roll(spark):
    bars = made(spark, {"X": ["A"] * 190 + ["B"] * 60})
    taken = snapshot_of(spark, bars, bar_count=50)
    state = taken.state().collect()
    assert len(state) == 1 and state[0]["is_open"]
    row = state[0]
    assert (row["bars"], row["span"], row["level_bars"], row["level_span"], row["detected_over_bars"]) == (50, "SingleContract", 200, "SpansRoll", 60)
    assert taken.shown().count() == 50
    zones, roll = taken.levels().orderBy("position").collect(), datetime.datetime(2024, 1, 24) + datetime.timedelta(hours=190)
    assert zones and {z["method"] for z in zones} == {"swing"} and all(z["formed_at"] >= roll for z in zones)
    assert [z["midpoint"] for z in zones] == sorted(z["midpoint"] for z in zones)
    absences = {r["method"]: r["absence"] for r in taken.methods().collect()}
    assert absences["swing"] is None and absences["volume-poc"] == levels.NO_TAPE and absences["session"] == levels.OVERHANG


def test_what_a_snapshot_refuses_and_empty_bars(spark):
    bars = made(spark, {"X": ["A"] * 3})
    for more in ({"resolutions": ()}, {"resolutions": (5, 0)}, {"resolutions": (5, 5)}, {"bar_count": 0}):
        with pytest.raises(ValueError):
            snapshot_of(spark, bars, **more)
    other = snapshot_of(spark, bars, resolutions=(5,))
    assert [t.count() for t in (other.state(), other.shown(), other.readings(), other.levels(), other.methods())] == [0] * 5
