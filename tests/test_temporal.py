import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lacuna.operators import gaps, temporal

N = None
EDGES = [N] * 3 + [1] + [N] * 7 + [9] + [N] * 4


def random_series(seed, n=400, missing=0.6):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=n).cumsum()
    x[rng.random(n) < missing] = np.nan
    return x


def as_list(x):
    return [None if np.isnan(v) else float(v) for v in x]


def close(got, want):
    assert len(got) == len(want)
    for g, w in zip(got, want):
        if w is None or (isinstance(w, float) and np.isnan(w)):
            assert g is None
        else:
            assert g == pytest.approx(w, abs=1e-9)


def test_limit_and_edges(series, column):
    got = column(temporal.linear(series(a=EDGES), limit=2))
    close(got, [N, 1, 1, 1, 2, 3, N, N, N, 7, 8, 9, 9, 9, N, N])


def test_trailing_edges(series, column):
    close(column(temporal.linear(series(a=EDGES), edges="trailing")), [N] * 3 + list(range(1, 10)) + [9] * 4)


def test_no_edges(series, column):
    close(column(temporal.linear(series(a=EDGES), edges="none")), [N] * 3 + list(range(1, 10)) + [N] * 4)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_linear_like_pandas_across_chunks(series, column, seed):
    """3,000 days cross two chunk borders; one gap covers a whole chunk."""
    x = random_series(seed, 3000)
    x[1000:2200] = np.nan
    got = column(temporal.linear(series(a=as_list(x))))
    close(got, pd.Series(x).interpolate(limit_direction="both").tolist())


@pytest.mark.parametrize("limit", [1, 5, 14])
def test_limit_like_pandas(series, column, limit):
    x = random_series(7, 400, 0.9)
    got = column(temporal.linear(series(a=as_list(x)), limit=limit))
    close(got, pd.Series(x).interpolate(limit=limit, limit_direction="both").tolist())


def test_time_axis_like_pandas(spark, column):
    x = random_series(11, 200)
    days = pd.date_range("2020-01-01", periods=200)[np.random.default_rng(0).permutation(200)[:120]].sort_values()
    y = pd.Series(x[:120], index=days)
    rows = [("a", d.date(), "v", None if np.isnan(v) else float(v)) for d, v in y.items()]
    df = spark.createDataFrame(rows, "location string, obs_date date, variable string, value double")
    close(column(temporal.linear(df, axis="day", edges="trailing")), y.interpolate(method="time").tolist())


@pytest.mark.parametrize("depth", [1, 2])
def test_chunk_size_does_not_matter(series, depth):
    df = series(a=as_list(random_series(5, 120, 0.8)), b=[None] * 120, c=[1.0] + [None] * 119)
    sides = ("prev", "next") if depth == 1 else ("before", "prev", "next", "after")
    cols = ["location", "obs_date", "pos", "pos_last", *[f"{s}_{f}" for s in sides for f in ("pos", "date", "value")]]
    tiny = gaps.neighbours(df, depth=depth, span_days=3).select(*cols).orderBy("location", "obs_date").collect()
    whole = gaps.neighbours(df, depth=depth, span_days=10**6).select(*cols).orderBy("location", "obs_date").collect()
    assert tiny == whole


def test_neighbours_beyond_by_brute_force(series):
    x = as_list(random_series(9, 90, 0.8))
    rows = gaps.neighbours(series(a=x), depth=2, span_days=7).orderBy("obs_date").collect()
    seen = [i for i, v in enumerate(x) if v is not None]
    for i, row in enumerate(rows):
        before, after = [j for j in seen if j <= i], [j for j in seen if j >= i]
        assert row["pos"] == i
        assert row["prev_pos"] == (before[-1] if before else None)
        assert row["next_pos"] == (after[0] if after else None)
        assert row["before_pos"] == (before[-2] if len(before) > 1 else None)
        assert row["after_pos"] == (after[1] if len(after) > 1 else None)
        assert row["after_value"] == (x[after[1]] if len(after) > 1 else None)


def test_quadratic_recovers_a_parabola(series, column):
    truth = [0.5 * i * i - 3 * i + 2 for i in range(30)]
    x = [v if i % 5 == 0 else None for i, v in enumerate(truth)]
    got = column(temporal.quadratic(series(a=x)))
    close(got[:26], truth[:26])
    assert got[26:] == [None] * 4


def test_quadratic_with_two_points_is_linear(series, column):
    close(column(temporal.quadratic(series(a=[1, N, N, 4, N]))), [1, 2, 3, 4, N])


def test_gap_runs(series):
    runs = gaps.gap_runs(series(a=[N, N, 1, N, 2, N, N, N], b=[N, N])).orderBy("location", "gap_start").collect()
    day = lambda i: dt.date(2020, 1, 1) + dt.timedelta(days=i)
    assert [(r["location"], r["gap_start"], r["gap_end"], r["gap_length"]) for r in runs] == [
        ("a", day(0), day(1), 2), ("a", day(3), day(3), 1), ("a", day(5), day(7), 3), ("b", day(0), day(1), 2),
    ]


def test_gap_adaptive_uses_each_gaps_own_rule(spark, series, column):
    n = 800
    x = [float(i * i) for i in range(n)]
    holed = [None if 10 <= i < 13 or 100 <= i < 115 or 400 <= i < 440 else v for i, v in enumerate(x)]
    got = column(temporal.gap_adaptive(series(a=holed)))
    close([got[11]], [81 + (169 - 81) / 4 * 2])
    close(got[100:115], x[100:115])
    # Day 400 of 2020 is 2021-02-04; the same day of 2020 is day 34, of 2022 day 765.
    close([got[400]], [(34.0**2 + 765.0**2) / 2])


def test_all_null_series_stays_null_until_the_global_mean(series, column):
    df = series(a=[1.0, 3.0, N], b=[N, N, N])
    assert column(temporal.linear(df), location="b") == [None] * 3
    assert column(temporal.ffill_bfill(df), location="b") == [None] * 3
    phased = temporal.three_phase(df)
    close(column(phased, location="a"), [1, 3, 3])
    close(column(phased, location="b"), [7 / 3] * 3)


def test_leap_day_climatology(series, column):
    n = 366 + 365 + 365 + 366
    x = [float(i) for i in range(n)]
    x[59] = None  # 2020-02-29
    got = column(temporal.climatology_month_day(series(a=x)))
    assert got[59] is None
    got = column(temporal.climatology_doy(series(a=x)))
    close([got[59]], [((366 + 59) + (731 + 59) + (1096 + 59)) / 3])


def test_imputer_learns_from_train_only(series, column):
    train, test = series(a=[2.0, 4.0]), series(a=[N, 9.0], c=[N, N])
    out = temporal.MeanImputer.fit(train).transform(test)
    close(column(out, location="a"), [3, 9])
    close(column(out, location="c"), [3, 3])


def test_median_is_exact(series, column):
    close(column(temporal.median_fill(series(a=[1, 2, N], b=[10, 20, N])), location="a"), [1, 2, 6])


def test_nowcast_rules(series):
    day = lambda s: F.lit(s).cast("date")
    df = series(fresh=[1, 2, 3, 4, 5], old=[1, N, N, N, N], line=[0, 10, 20, N, N], jump=[0, 0, 0, 100, N])
    at = {r["location"]: r for r in temporal.nowcast(df, day("2020-01-07")).collect()}
    assert at["fresh"]["nowcast"] == 5.0  # two days old: persistence
    assert at["line"]["nowcast"] == pytest.approx(25.0)  # trend 60 clamped to 20 + 20/4
    assert at["old"]["nowcast"] == 1.0  # a single point
    assert at["jump"]["nowcast"] == pytest.approx(min(120 + 0.0, 125.0), abs=30)
    late = {r["location"]: r["nowcast"] for r in temporal.nowcast(df, day("2020-01-20")).collect()}
    assert late["fresh"] is None and late["old"] is None


def test_provenance_labels(series):
    df = series(start="2020-03-01", a=[1.0, 2.0, 3.0], b=[5.0, N, N]).union(
        series(start="2019-03-01", c=[7.0]).union(series(start="2019-07-01", d=[8.0])).union(series(e=[N]))
    )
    got = {r["location"]: (r["value"], r["source"]) for r in temporal.with_fallbacks(df, F.lit("2020-03-03").cast("date")).collect()}
    assert got["a"] == (3.0, "observed")
    assert got["b"] == (5.0, "temporal_short_gap")
    assert got["c"] == (7.0, "climatological_location_month")
    assert got["d"] == (8.0, "climatological_location")
    assert got["e"][1] == "climatological_global"


def test_observed_cells_never_change_and_partitioning_does_not_matter(series):
    df = series(a=as_list(random_series(3)), b=as_list(random_series(4)))
    for fill in (temporal.linear, temporal.quadratic, temporal.three_phase, temporal.gap_adaptive, temporal.ffill_bfill):
        rows = {(r["location"], r["obs_date"]): r for r in fill(df).collect()}
        assert all(r["filled"] == r["value"] for r in rows.values() if r["value"] is not None)
        again = {(r["location"], r["obs_date"]): r for r in fill(df.repartition(13)).collect()}
        assert {k: r["filled"] for k, r in rows.items()} == pytest.approx({k: r["filled"] for k, r in again.items()})
