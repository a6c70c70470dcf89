import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from lacuna.session import fresh_path
from lacuna.sources import day_log

SCHEMA = "site string, prediction_timestamp timestamp, value double"


def at(day, hour, value, site="a"):
    return site, dt.datetime(2024, 1, day, hour), float(value)


@pytest.fixture
def log(spark):
    path = fresh_path(spark, "daylog")
    return path, lambda rows: day_log.add_predictions(spark.createDataFrame(rows, SCHEMA), path, ("site",)), lambda *days: sorted(
        map(tuple, day_log.read_log(spark, path, SCHEMA, list(days) or None).collect())
    )


def test_the_first_of_a_day_stays(spark, log):
    path, add, rows = log
    assert rows() == [] and add([]) == 0
    assert add([at(1, 9, 1), at(1, 8, 2), at(2, 7, 3), at(1, 5, 4, "b")]) == 2
    assert rows() == [at(1, 8, 2), at(2, 7, 3), at(1, 5, 4, "b")]
    assert add([at(2, 6, 9), at(3, 1, 5), ("c", None, 1.0)]) == 2
    assert rows() == [at(1, 8, 2), at(2, 7, 3), at(3, 1, 5), at(1, 5, 4, "b")]
    assert rows("2024-01-03") == [at(3, 1, 5)]


def test_one_file_a_day_and_only_touched_days_change(spark, log):
    path, add, rows = log
    for day in (1, 2, 1, 1, 2):
        add([at(day, 5, day, f"s{k}") for k in range(day * 3)])
    now = day_log.manifest(spark, path)
    assert sorted(now) == ["2024-01-01", "2024-01-02"]
    for folder in now.values():
        assert sum(f.endswith(".parquet") for f in os.listdir(folder)) == 1
    before = now["2024-01-02"]
    add([at(1, 5, 7, "new")])
    after = day_log.manifest(spark, path)
    assert after["2024-01-02"] == before and after["2024-01-01"] != now["2024-01-01"]


def test_a_broken_off_update_is_not_seen_and_a_retry_adds_nothing_twice(spark, log, monkeypatch):
    path, add, rows = log
    add([at(1, 5, 1)])
    monkeypatch.setattr(day_log, "_fs", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        add([at(1, 6, 2, "b")])
    monkeypatch.undo()
    assert rows() == [at(1, 5, 1)]
    for _ in range(2):
        add([at(1, 6, 2, "b")])
        assert rows() == [at(1, 5, 1), at(1, 6, 2, "b")]


def test_names_by_alias(spark):
    from lacuna.operators import lookup

    asked = spark.createDataFrame([("bay", 1), ("unknown", 2), (None, 3)], "location string, k int")
    names = spark.createDataFrame([("bay", "Site A"), ("cove", "Site B")], "alias string, name string")
    got = sorted((r.k, r.alias, r.location) for r in lookup.by_alias(asked, names).collect())
    assert got == [(1, "bay", "Site A"), (2, "unknown", None), (3, None, None)]


def test_totals_close_without_a_sink(spark):
    from lacuna.streaming import prediction_log

    events = spark.createDataFrame([("x", dt.datetime(2024, 1, 1, 3), 1.0), ("x", dt.datetime(2024, 1, 2, 3), 2.0)], "event_type string, ts timestamp, value double")
    none = spark.createDataFrame([], "event_type string, day date, n long, total double")
    assert prediction_log.close_totals(none, events).count() == 2
    some = spark.createDataFrame([("x", dt.date(2024, 1, 1), 1, 1.0)], none.schema)
    assert prediction_log.close_totals(some, events).agg(F.sum("n")).first()[0] == 2
