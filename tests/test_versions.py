"""Commits to stored tables: what is rewritten, what a reader sees, what a crash leaves."""

import pytest
from pyspark.sql import functions as F

from barloom.sources.storage import scratch
from barloom.sources.versions import VersionedTable

KEYS = ["name", "day"]
SCHEMA = "name string, day int, value long"


def changes(spark, rows):
    return spark.createDataFrame(rows, f"{SCHEMA}, change string")


def rows(table):
    return sorted((tuple(r) for r in table.read().collect()), key=repr)


@pytest.fixture
def table(spark):
    made = VersionedTable(spark, scratch(spark, "versions"), spark.createDataFrame([], SCHEMA).schema, ["day % 10"])
    assert made.commit(changes(spark, [("a", 1, 10, "insert"), ("a", 2, 20, "insert"), (None, 2, 21, "insert"), ("b", 13, 30, "insert"), ("c", None, 40, "insert")]), KEYS, "first")
    return made


def files(table):
    return {(r["f"], r["day"]) for r in table.read().select(F.input_file_name().alias("f"), "day").collect()}


def test_only_partitions_with_a_change_are_rewritten(spark, table):
    before = files(table)
    assert table.commit(changes(spark, [("a", 2, 22, "update"), ("d", 12, 50, "insert"), ("b", 13, None, "delete"), (None, 2, 23, "update"), ("c", None, 41, "update")]), KEYS, "second")
    assert rows(table) == sorted([("a", 1, 10), ("a", 2, 22), (None, 2, 23), ("d", 12, 50), ("c", None, 41)], key=repr)
    after = files(table)
    assert {f for f, d in before if d == 1} == {f for f, d in after if d == 1}
    assert not {f for f, d in before if d != 1} & {f for f, _ in after}
    # a table may become empty, and grow again
    assert table.commit(table.read().withColumn("change", F.lit("delete")), KEYS, "third") and rows(table) == []
    assert table.commit(changes(spark, [("z", 5, 1, "insert")]), KEYS, "fourth") and rows(table) == [("z", 5, 1)]


def test_a_crash_between_stage_and_commit_changes_nothing(spark, table, monkeypatch):
    before, reader = rows(table), table.read()
    more = [("a", 1, 11, "update"), ("e", 7, 70, "insert")]

    def crash(*_):
        raise OSError("lost")

    monkeypatch.setattr(table, "_publish", crash)
    for _ in range(2):
        with pytest.raises(OSError):
            table.commit(changes(spark, more), KEYS, "second")
        assert rows(table) == before
    monkeypatch.undo()
    again = VersionedTable(spark, table.path, table.schema, table.parts)  # as a new run opens it
    assert again.commit(changes(spark, more), KEYS, "second")
    assert rows(table) == sorted([*[r for r in before if r != ("a", 1, 10)], ("a", 1, 11), ("e", 7, 70)], key=repr)
    assert sorted((tuple(r) for r in reader.collect()), key=repr) == before  # who reads the old version goes on reading it


def test_a_repeated_commit_writes_nothing(spark, table):
    more = changes(spark, [("a", 1, 11, "update")])
    assert table.commit(more, KEYS, "second")
    seen = files(table)
    assert not table.commit(more, KEYS, "second") and not table.commit(more, KEYS, "first") and files(table) == seen
    assert table.commit(changes(spark, []), KEYS, "none") and files(table) == seen


def test_two_writers_are_told(spark, table):
    other = VersionedTable(spark, table.path, table.schema, table.parts)
    number, _ = table._newest()
    other._publish(number + 1, "x", {})
    table._publish(number + 1, "y", {})
    with pytest.raises(RuntimeError):
        table.read()
    with pytest.raises(ValueError):
        table.commit(changes(spark, []), KEYS, "../up")
