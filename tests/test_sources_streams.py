import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from lacuna.operators import forecast
from lacuna.session import fresh_path, shared_dir
from lacuna.sources import files, stores, tables
from lacuna.streaming import prediction_log as log


def test_shared_folder_comes_from_the_session(spark):
    assert shared_dir(spark) == spark.sparkContext.getConf().get("spark.checkpoint.dir")


def test_panel_csv_turns_nan_and_blanks_into_null(spark, tmp_path):
    f = tmp_path / "p.csv"
    f.write_text("location,obs_date,a,b\nx,2020-01-01,1.5,NaN\nx,2020-01-02,,2\n")
    rows = files.read_panel_csv(spark, str(f), ["a", "b"]).orderBy("obs_date").collect()
    assert [(r["obs_date"], r["a"], r["b"]) for r in rows] == [(dt.date(2020, 1, 1), 1.5, None), (dt.date(2020, 1, 2), None, 2.0)]


def test_lenient_reader(spark):
    df = spark.createDataFrame([("2020-01-01", "3.5"), ("nope", "1"), ("2020-01-02", "x"), (None, "1"), ("2020-01-03", "NaN")], "d string, v string")
    rows = files.lenient(df, "d", ["v"]).orderBy("d").collect()
    assert [(str(r["d"]), r["v"]) for r in rows] == [("2020-01-01", 3.5), ("2020-01-02", 0.0), ("2020-01-03", 0.0)]


def test_masked_sets_are_pruned_by_directory(spark):
    path = fresh_path(spark, "m")
    df = spark.createDataFrame([("r", 1, 1.0), ("r", 2, 2.0), ("b", 1, 3.0)], "mask_type string, split_num int, v double")
    files.write_masked(df, path)
    assert sorted(os.listdir(f"{path}/mask_type=r"))[:2] == ["split_num=1", "split_num=2"]
    back = files.read_masked(spark, path, "r", 2)
    assert [r["v"] for r in back.collect()] == [2.0]
    assert "PartitionFilters: [isnotnull(mask_type" in back._jdf.queryExecution().toString()


def test_forecast_rerun_replaces_its_own_day(spark):
    path = fresh_path(spark, "f")
    mk = lambda d, r: spark.createDataFrame([(dt.date(2024, 1, d), "a", r)], "run_date date, location string, risk_level string")
    for d, r in ((1, "x"), (2, "y"), (2, "z")):
        files.write_forecasts(mk(d, r), path)
    rows = spark.read.json(path)
    assert {(str(r["run_date"]), r["risk_level"]) for r in rows.collect()} == {("2024-01-01", "x"), ("2024-01-02", "z")}
    assert [r["risk_level"] for r in files.latest_snapshot(rows).collect()] == ["z"]


def test_geojson(spark, tmp_path):
    text = '{"type":"FeatureCollection","features":[{"properties":{"name":"s1"},"geometry":{"type":"Polygon","coordinates":[[[1,2],[3,2],[3,4],[1,2]]]}},{"properties":{"name":"s2"},"geometry":{"type":"Polygon","coordinates":[[[0,0],[1,0],[0,0]]]}}]}'
    (tmp_path / "a.geojson").write_text(text.replace(",{", ",\n{"))
    got = {r["site"]: r["ring"] for r in files.read_geojson(spark, str(tmp_path)).collect()}
    assert got["s1"][1] == [3.0, 2.0] and len(got["s2"]) == 3


def test_large_collections_are_read_in_splits(spark, tmp_path):
    """One file, indented in several ways, with braces, quotes and the word itself in its texts."""
    import json
    import random

    rng = random.Random(1)
    features = []
    for i in range(3000):
        x, y = rng.uniform(-170, 170), rng.uniform(-80, 80)
        kind, place = rng.choice([("Point", [x, y]), ("Polygon", [[[x, y], [x + 1, y], [x, y + 1], [x, y]]]), ("LineString", [[x, y], [y, x]])])
        named = {rng.choice(["name", "Name"]): f'{i} {{"type": "Feature"}} }}, {{ \\ é', "other": i}
        features.append({"type": "Feature", "id": i, "properties": named if i % 50 else {}, "geometry": {"type": kind, "coordinates": place}})
    parts = [json.dumps(f, indent=rng.choice([None, 1, 4]), ensure_ascii=False) for f in features]
    text = '{ "type": "FeatureCollection", "name": "Feature x",\n"features": [' + ",\n ".join(parts) + "]}\n"
    (tmp_path / "sites.geojson").write_text(text)
    key = lambda r: (str(r.site), str(r.ring))
    want = sorted(map(key, files.read_geojson(spark, str(tmp_path)).collect()))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        rows = files.read_geojson_features(spark, str(tmp_path))
        assert rows.select(F.spark_partition_id().alias("p")).distinct().count() > 3
        assert sorted(map(key, rows.collect())) == want and len(want) == 3000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_geojson_points_and_other_spellings(spark):
    text = '{"type":"FeatureCollection","features":[{"properties":{"Name":"p","depth":3},"geometry":{"type":"Point","coordinates":[120.5,14.25]}},{"properties":{"name":"line"},"geometry":{"type":"LineString","coordinates":[[0,0],[1,1]]}}]}'
    rows = files.parse_geojson(spark.createDataFrame([(text,)], "text string")).collect()
    assert [(r["site"], r["ring"]) for r in rows] == [("p", [[120.5, 14.25]]), ("line", None)]


def test_table_is_read_as_it_is_now(spark):
    path = fresh_path(spark, "changing")
    for schema in ("a int", "a int, b string"):
        spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{path}/t.parquet")
        assert tables.table(spark, path, "t").columns == [c.split()[0] for c in schema.split(", ")]


def test_new_locations_follow_the_greatest_id_and_repeat_nothing(spark):
    dim = spark.createDataFrame([(7, "x")], "location_id int, location_name string")
    names = spark.createDataFrame([("x",), ("y",), ("z",), ("y",)], "location_name string")
    added = stores.new_locations(names, dim)
    assert sorted((r[0], r[1]) for r in added.collect())[0][0] == 8 and {r[1] for r in added.collect()} == {"y", "z"}
    assert stores.new_locations(names, dim.union(added)).count() == 0
    assert [r[0] for r in stores.new_locations(names, dim.limit(0)).orderBy("location_id").collect()] == [1, 2, 3]


def test_history_rows_variants(spark):
    panel = spark.createDataFrame([("x", dt.date(2020, 1, 1), 0.5, 20.0), ("x", dt.date(2020, 1, 2), None, 21.0), ("q", dt.date(2020, 1, 1), 1.0, 1.0)], "location string, obs_date date, label double, thetao double")
    dim = spark.createDataFrame([(3, "x")], "location_id int, location_name string")
    rows = stores.history_rows(panel, dim, {"thetao": "sst"}).orderBy("date").collect()
    assert [(r["location_id"], r["redtide_present"], r["sst"]) for r in rows] == [(3, True, 20.0), (3, False, 21.0)]
    assert not stores.history_rows(panel, dim, {"thetao": "sst"}, threshold=1.0, inclusive=True).filter("redtide_present").count()


def test_predictions_once_per_day(spark):
    ts = lambda s: dt.datetime.fromisoformat(s)
    schema = "location_id int, prediction_timestamp timestamp, v int"
    batch = spark.createDataFrame([(1, ts("2024-01-01T08:00"), 1), (1, ts("2024-01-01T06:00"), 2), (1, ts("2024-01-02T06:00"), 3), (2, ts("2024-01-01T06:00"), 4)], schema)
    old = spark.createDataFrame([(2, ts("2024-01-01T23:00"), 9)], schema)
    got = sorted((r["location_id"], r["v"]) for r in stores.new_predictions(batch, old).collect())
    assert got == [(1, 2), (1, 3)]


@pytest.fixture(scope="module")
def event_files(spark, sf):
    """Event rows in four files, as four arrivals."""
    path = fresh_path(spark, "events")
    events = tables.table(spark, sf, "events")
    for k in range(4):
        events.filter(F.pmod("event_id", F.lit(4)) == k).coalesce(1).write.mode("append").parquet(path)
    return f"{path}/*.parquet", events


def test_log_over_several_batches_and_restarts(spark, event_files):
    source, events = event_files
    path = fresh_path(spark, "log")
    for run in ("one", "one", "two"):
        log.append_log(log.read_events(spark, source), path, f"{path}-cp-{run}", run=run).awaitTermination()
    rows = spark.read.parquet(path)
    keys = rows.groupBy("event_type", "day").count()
    assert keys.filter("count > 1").count() == 0
    assert keys.count() == events.select("event_type", F.to_date("ts")).distinct().count()
    assert rows.select("epoch").distinct().count() > 1


def test_a_retried_batch_neither_doubles_nor_loses_rows(spark, event_files):
    source, events = event_files
    path = fresh_path(spark, "log")
    # The same batches under a fresh checkpoint and the same run name: a full retry.
    for attempt in ("a", "b"):
        log.append_log(log.read_events(spark, source), path, f"{path}-cp-{attempt}", run="r").awaitTermination()
    rows = spark.read.parquet(path)
    assert rows.count() == events.select("event_type", F.to_date("ts")).distinct().count()


def test_first_per_day_and_totals(spark, event_files):
    source, events = event_files
    out = fresh_path(spark, "first")
    log.first_per_day(log.read_events(spark, source), "40 days").writeStream.format("parquet").option("path", out).option(
        "checkpointLocation", f"{out}-cp"
    ).trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(out).count() == events.select("event_type", F.to_date("ts")).distinct().count()
    out = fresh_path(spark, "totals")
    log.daily_totals(log.read_events(spark, source), "40 days").writeStream.format("parquet").outputMode("append").option("path", out).option(
        "checkpointLocation", f"{out}-cp"
    ).trigger(availableNow=True).start().awaitTermination()
    assert spark.read.schema("event_type string, day date, n long, total double").parquet(out).count() == 0


def test_alerts_filter_reaches_the_scan(spark):
    path = fresh_path(spark, "labels")
    spark.createDataFrame([("San José", dt.date(2020, 1, i), float(i % 2)) for i in range(1, 9)] + [("b", dt.date(2020, 1, 1), None)], "location string, obs_date date, label double").write.parquet(path)
    rows = forecast.alerts(spark.read.parquet(path), "san_josé", "2020-01-02", "2020-01-05")
    assert rows.agg(F.sum("is_alert")).first()[0] == 2 and rows.count() == 4
    assert "GreaterThanOrEqual(obs_date,2020-01-02)" in rows._jdf.queryExecution().toString()
    assert forecast.alerts(spark.read.parquet(path)).filter("location = 'b'").first()["is_alert"] == 0
