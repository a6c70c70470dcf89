import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lacuna.functions import expr as E
from lacuna.operators import features, forecast, lookup, panel, zonal


@pytest.fixture(scope="module")
def wide(spark):
    """Two sites, 2,200 days (two chunk borders), a fifth missing."""
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2, 2200)).cumsum(axis=1)
    x[rng.random(x.shape) < 0.2] = np.nan
    days = pd.date_range("2016-01-01", periods=2200)
    rows = [(s, d.date(), None if np.isnan(v) else float(v)) for s, xs in zip("ab", x) for d, v in zip(days, xs)]
    return x, spark.createDataFrame(rows, "location string, obs_date date, v double").cache()


def frame(df, name, site="a"):
    rows = df.filter(F.col("location") == site).orderBy("obs_date").select(name).collect()
    return np.array([np.nan if r[0] is None else r[0] for r in rows], dtype=float)


@pytest.mark.parametrize("n", [7, 30])
def test_rolling_like_pandas(wide, n):
    x, df = wide
    out = features.rolling(df, ["v"], (7, 30)).cache()
    s = pd.Series(x[0])
    assert out.count() == 4400
    np.testing.assert_allclose(frame(out, f"v_mean{n}"), s.rolling(n, min_periods=1).mean(), atol=1e-9)
    np.testing.assert_allclose(frame(out, f"v_std{n}"), s.rolling(n, min_periods=1).std().fillna(0), atol=1e-7)


def test_lags_like_pandas(wide):
    x, df = wide
    out = features.lags(df, ["v"], (1, 30))
    for n in (1, 30):
        s = pd.Series(x[1]).shift(n)
        np.testing.assert_allclose(frame(out, f"v_lag{n}", "b"), s.fillna(s.mean()), atol=1e-9)


def test_feature_matrix_equals_its_parts(wide):
    _, df = wide
    m = features.feature_matrix(df, ["v"], None, "v", "v")
    parts = features.rolling(df, ["v"])
    np.testing.assert_allclose(frame(m, "v_std14"), frame(parts, "v_std14"))
    np.testing.assert_allclose(frame(m, "v_lag7"), frame(features.lags(df, ["v"]), "v_lag7"))
    np.testing.assert_allclose(frame(m, "v_anomaly"), frame(features.derived(df, "v", "v"), "v_anomaly"))
    assert m.count() == df.count()


def test_one_observation_has_no_spread(spark):
    df = spark.createDataFrame([("a", dt.date(2020, 1, 1), 5.0)], "location string, obs_date date, v double")
    r = features.rolling(df, ["v"], (7,)).first()
    assert (r["v_mean7"], r["v_std7"]) == (5.0, 0.0)


def test_sequences_and_padding(spark):
    rows = [("a", dt.date(2020, 1, i), float(i), i % 2) for i in range(1, 7)] + [("b", dt.date(2020, 1, 1), None, 1)]
    df = spark.createDataFrame(rows, "location string, obs_date date, v double, label int")
    out = features.sequences(df, ["v"], "label", 3).orderBy("window_end").collect()
    assert [(r["window_end"].day, r["target_date"].day, r["target"], [s["v"] for s in r["sequence"]]) for r in out] == [
        (3, 4, 0, [1, 2, 3]), (4, 5, 1, [2, 3, 4]), (5, 6, 0, [3, 4, 5]),
    ]
    padded = {r["location"]: [s["v"] for s in r["sequence"]] for r in features.padded_sequence(df, ["v"], 8).collect()}
    assert padded == {"a": [1, 1, 1, 2, 3, 4, 5, 6], "b": [0.0] * 8}


def test_minmax_fits_on_train_and_keeps_constants(spark):
    train = spark.createDataFrame([(1, 0.0, 3.0), (1, 10.0, 3.0)], "split_num int, x double, c double")
    test = spark.createDataFrame([(1, 20.0, 4.0), (1, None, 3.0)], "split_num int, x double, c double")
    s = features.MinMax.fit(train, ["x", "c"])
    got = sorted((r["x"], r["c"]) for r in s.transform(test).collect())
    assert got == [(0.0, 0.0), (2.0, 1.0)]


def test_numeric_features(spark):
    df = spark.createDataFrame([(1, 2.0, "x", 1)], "id int, a double, s string, label int")
    assert features.numeric_features(df, ["id", "label"]) == ["a"]


def test_flags(spark):
    df = spark.createDataFrame([("a", dt.date(2020, 1, 1)), ("a", dt.date(2020, 1, 2))], "location string, obs_date date")
    mask = spark.createDataFrame([("a", dt.date(2020, 1, 2), "v", True), ("a", dt.date(2020, 1, 1), "v", False)], "location string, obs_date date, variable string, is_masked boolean")
    assert [r["v_was_imputed"] for r in features.imputation_flags(df, mask, ["v"]).orderBy("obs_date").collect()] == [0, 1]


# --- lookups -------------------------------------------------------------------


@pytest.fixture(scope="module")
def readings(spark):
    day = lambda s: dt.date.fromisoformat(s)
    r = spark.createDataFrame([("a", day("2020-01-01"), 1.0), ("a", day("2020-01-05"), 5.0), ("a", day("2019-06-01"), 0.5), ("a", day("2020-01-04"), None)], "location string, obs_date date, v double")
    t = spark.createDataFrame([("a", day(x)) for x in ("2020-01-03", "2020-01-05", "2020-01-12", "2020-01-13", "2018-01-01")] + [("z", day("2020-01-01"))], "location string, obs_date date")
    return t, r


def test_asof_tolerance(readings):
    got = {(r["location"], str(r["obs_date"])): (r["v"], r["age_days"]) for r in lookup.asof(*readings, ["v"], 7).collect()}
    assert got == {
        ("a", "2020-01-03"): (1.0, 2), ("a", "2020-01-05"): (5.0, 0), ("a", "2020-01-12"): (5.0, 7),
        ("a", "2020-01-13"): (None, None), ("a", "2018-01-01"): (None, None), ("z", "2020-01-01"): (None, None),
    }


def test_nearest_prefers_the_earlier_day_on_a_tie(readings):
    got = {(r["location"], str(r["obs_date"])): (r["v"], r["days_apart"]) for r in lookup.nearest_date(*readings, ["v"]).collect()}
    assert got[("a", "2020-01-03")] == (1.0, 2) and got[("a", "2020-01-05")] == (5.0, 0)
    assert got[("a", "2018-01-01")] == (0.5, 516) and got[("z", "2020-01-01")] == (None, None)


def test_trailing_windows_leave_out_today(spark):
    rows = [("a", dt.date(2020, 1, i), float(i)) for i in (1, 2, 3, 4, 9)]
    df = spark.createDataFrame(rows, "location string, obs_date date, v double")
    got = [r["s"] for r in lookup.trailing(df, {"s": (F.sum("v"), 3)}).orderBy("obs_date").collect()]
    assert got == [None, 1.0, 3.0, 6.0, None]


def test_dedup_first_and_last(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 5, None)], "k string, o int, v string")
    last = {r["k"]: r["v"] for r in panel.dedup(df, ["k"], ["o"]).collect()}
    first = {r["k"]: r["v"] for r in panel.dedup(df, ["k"], ["o"], "first").collect()}
    assert last == {"a": "y", "b": None} and first == {"a": "x", "b": None}


# --- zonal ---------------------------------------------------------------------


def test_zonal_boxes_and_bounds_are_inclusive(spark):
    ring = [[0.0, 0.0], [2.0, 0.0], [2.0, 1.0], [0.0, 1.0], [0.0, 0.0]]
    sites = spark.createDataFrame([("s", ring)], "site string, ring array<array<double>>")
    b = zonal.site_boxes(sites, buffer_m=111000.0).first()
    assert (b["lon_min"], b["lat_max"]) == (-1.0, 2.0) and b["area_km2"] == pytest.approx(4 * 3 * 111**2)
    cells = spark.createDataFrame(
        [(0.0, 0.0, 1.0), (1.0, 2.0, 3.0), (1.01, 2.0, 99.0), (0.5, 0.5, None), (0.5, -0.01, 99.0)], "lat double, lon double, v double"
    ).withColumn("obs_date", F.lit("2020-01-01").cast("date"))
    out = zonal.zonal_mean(cells, zonal.site_boxes(sites), ["v"]).collect()
    assert [(r["site"], r["v"]) for r in out] == [("s", 2.0)]


def test_gradient_like_numpy(spark):
    g = np.random.default_rng(0).normal(size=(4, 5))
    rows = [(1, i, j, float(g[i, j])) for i in range(4) for j in range(5)]
    df = spark.createDataFrame(rows, "k int, lat int, lon int, v double")
    r = zonal.spatial_gradient(df, ["k"], "v").first()
    gy, gx = np.gradient(g)
    assert (r["grad_y"], r["grad_x"]) == pytest.approx((gy.mean(), gx.mean()))
    assert r["gradient"] == pytest.approx(np.hypot(gx.mean(), gy.mean()))


def test_dimension_aliases(spark):
    df = spark.createDataFrame([(1, 2, 3)], "nav_lat int, X int, lev int")
    assert zonal.canonical_dimensions(df).columns == ["lat", "lon", "depth"]


def test_qa_bits(spark):
    df = spark.createDataFrame([(0,), (1 << 10,), (1 << 11,), ((1 << 9) + (1 << 12),)], "q int")
    assert [r[0] for r in df.select(E.clear_sky(F.col("q"))).collect()] == [True, False, False, True]


# --- forecast ------------------------------------------------------------------


def test_ladders_at_their_bounds(spark):
    df = spark.createDataFrame([(p,) for p in (0.19, 0.2, 0.4, 0.5, 0.7, 0.8)], "p double")
    p = F.col("p")
    got = df.select(E.ladder(p), E.ladder(p, E.SERVICE_LADDER), E.ladder(p, E.HORIZON_LADDER, "Low Risk", inclusive=False)).collect()
    short = [tuple(x.replace(" Risk", "") for x in r) for r in got]
    assert short == [
        ("Very Low", "Very Low", "Low"), ("Low", "Low", "Low"), ("Low", "Moderate", "Low"),
        ("Moderate", "Moderate", "Moderate"), ("Moderate", "High", "Moderate"), ("High", "High", "High"),
    ]


def test_risk_rules(spark):
    rows = [("a", 0.05, False, False), ("b", 0.05, True, False), ("c", 0.3, False, True), ("d", 0.05, True, True), ("e", 0.9, True, True), ("f", 0.9, False, None)]
    df = spark.createDataFrame(rows, "location string, probability double, data_limited boolean, has_signal boolean")
    got = {r["location"]: (r["risk_level"], round(r["confidence"], 3)) for r in forecast.risk(df).collect()}
    assert got == {
        "a": ("Very Low Risk", 0.95), "b": ("Low Risk", 0.65), "c": ("Moderate Risk", 0.7), "d": ("Moderate Risk", 0.65),
        "e": ("High Risk", 0.65), "f": ("High Risk", 0.9),
    }


def test_horizon_floor_only_for_confident_forecasts(spark):
    df = spark.createDataFrame([("a", 0.9, 0.71), ("b", 0.9, 0.6)], "location string, probability double, confidence double")
    out = forecast.horizon(df, F.lit("2024-02-28").cast("date")).orderBy("location", "forecast_day").collect()
    a, b = out[:6], out[6:]
    assert a[0]["probability"] == pytest.approx(0.81) and a[0]["day_label"] == "Thu" and str(a[1]["date"]) == "2024-03-01"
    assert a[5]["confidence"] == pytest.approx(max(0.5, 0.71 * 0.95**6)) and b[5]["confidence"] == pytest.approx(0.6 * 0.95**6)
    assert [r["risk_level"] for r in a] == ["High Risk"] * 2 + ["Moderate Risk"] * 4


def test_colours_and_keys_differ_for_very_low(spark):
    df = spark.createDataFrame([(x,) for x in ("High Risk", "Moderate Risk", "Low Risk", "Very Low Risk", "Green", None)], "l string")
    got = df.select(E.risk_colour(F.col("l")), E.risk_key(F.col("l"))).collect()
    assert [tuple(r) for r in got] == [("red", "red"), ("orange", "orange"), ("yellow", "yellow"), ("green", "yellow"), ("green", "green"), ("green", "green")]


def test_location_keys_keep_letters_of_any_script(spark):
    df = spark.createDataFrame([("San José_Bay 2",), ("Ñ-Ü!",)], "n string")
    assert [r[0] for r in df.select(E.location_key(F.col("n"))).collect()] == ["sanjosébay2", "ñü"]


def test_recent_signal(spark):
    day = lambda n: dt.date(2024, 1, 1) - dt.timedelta(days=n)
    rows = [("hit", day(90), 1.0), ("late", day(91), 1.0), ("late", day(10), 0.0), ("rate", day(300), 0.5)] + [("rate", day(100 + i), 0.0) for i in range(9)]
    rows += [("none", day(5), 0.0), ("future", day(-3), 1.0)]
    df = spark.createDataFrame(rows, "location string, obs_date date, label double")
    got = {r["location"]: (r["days_since_last_positive"], r["recent_positive_rate_90d"], r["has_signal"]) for r in forecast.recent_signal(df, F.lit("2024-01-01").cast("date")).collect()}
    assert got == {"hit": (90, 1.0, True), "late": (91, 0.0, True), "rate": (300, None, True), "none": (None, 0.0, False)}


def test_outlook_is_padded_and_cut(spark):
    rows = [("a", 0, dt.date(2024, 1, 1), "x", 1.0), ("a", 1, dt.date(2024, 1, 2), "y", 2.0)] + [("b", i, dt.date(2024, 1, 1 + i), "z", 1.0) for i in range(9)]
    df = spark.createDataFrame(rows, "location string, day int, date date, risk_level string, confidence double")
    out = forecast.pad_outlook(df, 7).orderBy("location", "day").collect()
    assert [(r["day"], r["date"].day, r["risk_level"]) for r in out if r["location"] == "a"] == [(0, 1, "x")] + [(i, i + 1, "y") for i in range(1, 7)]
    assert len([r for r in out if r["location"] == "b"]) == 7


def test_quarters_only_beyond_two_years(spark):
    months = lambda n: spark.createDataFrame([(f"{2020 + i // 12}-{i % 12 + 1:02d}", 1) for i in range(n)], "label string, value long")
    assert forecast.quarterly_alerts(months(24)).count() == 24
    got = {r["period"]: r["value"] for r in forecast.quarterly_alerts(months(25)).collect()}
    assert got["2020-Q1"] == 3 and got["2022-Q1"] == 1 and len(got) == 9


def test_risk_comparison_reports_unknown_levels(spark):
    df = spark.createDataFrame([(" high risk", "Low Risk"), ("Odd", "Low Risk")], "p string, a string")
    a, b = forecast.compare_risk(df, "p", "a").collect()
    assert (a["correct"], a["difference"], a["error"]) == (False, -2, None)
    assert b["error"] == "Invalid risk level: Odd" and b["correct"] is False


def test_document_texts(spark):
    rows = [("a", 0.9, 0.9, "High Risk", False, False, 1.5, 4, 1.0), ("b", 0.1, 0.65, "Low Risk", True, False, None, 1, 0.25)]
    df = spark.createDataFrame(rows, "location string, probability double, confidence double, risk_level string, data_limited boolean, has_signal boolean, CHL double, critical_available int, observed_ratio double")
    df = df.withColumn("latitude", F.lit(1.0)).withColumn("longitude", F.lit(2.0))
    a, b = forecast.document(df, F.lit("2024-01-01").cast("date")).orderBy("location").collect()
    assert a["confidence"] == "90.0%" and a["red_tide_probability"] == "High" and a["environmental_data"]["Chlorophyll-a"] == "1.5 mg/m3"
    assert len(a["recommendations"]) == 3 and len(b["recommendations"]) == 5 and b["environmental_data"]["Chlorophyll-a"] == "N/A"
    assert a["five_day_forecast"][0]["probability"] == "High" and b["explanation"].startswith("Forecast generated with limited")


@pytest.mark.parametrize(("n", "missing"), [(2600, 0.5), (2600, 0.97)])
def test_look_back_by_rows_on_an_irregular_panel(spark, n, missing):
    """Rows on some days only: frames of rows reach over any number of chunks of days."""
    rng = np.random.default_rng(n)
    day0 = dt.date(1990, 1, 1)
    days = [i for i in range(n * 4) if rng.random() > missing][:n]
    x = rng.normal(size=len(days)).cumsum()
    x[rng.random(len(days)) < 0.1] = np.nan
    rows = [(loc, day0 + dt.timedelta(days=i), None if np.isnan(v) else float(v)) for loc in "ab" for i, v in zip(days, x, strict=True)]
    df = spark.createDataFrame(rows, "location string, obs_date date, v double")
    longest = 2000 if len(days) > 2000 else 200
    out = features.lags(features.rolling(df, ["v"], (7, longest)), ["v"], (1, 30)).filter("location = 'b'").orderBy("obs_date").toPandas()
    want = pd.Series(x)
    for k in (7, longest):
        np.testing.assert_allclose(out[f"v_mean{k}"].astype(float), want.rolling(k, min_periods=1).mean(), atol=1e-9)
        np.testing.assert_allclose(out[f"v_std{k}"].astype(float), want.rolling(k, min_periods=1).std().fillna(0), atol=1e-7)
    for k in (1, 30):
        lag = want.shift(k)
        np.testing.assert_allclose(out[f"v_lag{k}"].astype(float), lag.fillna(lag.mean()), atol=1e-9)


def test_regular_panels_may_look_back_further_than_a_chunk(spark):
    rows = [("a", dt.date(2000, 1, 1) + dt.timedelta(days=i), float(i % 13)) for i in range(3500)]
    df = spark.createDataFrame(rows, "location string, obs_date date, v double")
    a, b = (features.rolling(df, ["v"], (1500,), regular=r).orderBy("obs_date").toPandas() for r in (True, False))
    np.testing.assert_allclose(a["v_mean1500"], b["v_mean1500"])
    np.testing.assert_allclose(a["v_mean1500"], pd.Series([r[2] for r in rows]).rolling(1500, min_periods=1).mean())
