import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from lacuna.operators import hybrid, spatial
from lacuna.operators.panel import with_donor
from lacuna.sources.files import stored


@pytest.fixture(scope="module")
def donors(spark):
    return spark.createDataFrame([("a", "b", 50.0)], "target string, donor string, distance_km double")


def noisy(seed, n=60, holes=()):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=n).cumsum().round(3)
    return [None if i in holes else float(v) for i, v in enumerate(x)]


def test_kriging_mixes_sample_and_population(series, donors, column):
    pairs = with_donor(series(a=[1, 2, 3, None], b=[2, 4, 7, 5]), donors)
    got = column(spatial.kriging(pairs, min_pairs=3), location="a")
    assert got[3] == pytest.approx(2 + 2.5 / (38 / 9) * (5 - 13 / 3))
    assert column(spatial.kriging(pairs), location="a")[3] is None


def test_kriging_with_constant_donor(series, donors, column):
    pairs = with_donor(series(a=[1, 2, 3, None], b=[4, 4, 4, 4]), donors)
    assert column(spatial.kriging(pairs, min_pairs=3), location="a")[3] == pytest.approx(2.0)


def test_one_predictor_regression(series, donors, column):
    pairs = with_donor(series(a=[2, 4, 7, None], b=[1, 2, 3, 10]), donors)
    assert column(spatial.regression1(pairs, min_rows=3), location="a")[3] == pytest.approx(25 - 2 / 3)


def test_three_predictors_like_least_squares(series, donors, column):
    b = noisy(1)
    a = noisy(2, holes=(30, 31, 45))
    got = column(spatial.regression3(spatial.with_donor_lags(series(a=a, b=b), donors, (1, 7))), location="a")
    rows = [i for i in range(7, 60) if a[i] is not None]
    X = np.array([[1, b[i], b[i - 1], b[i - 7]] for i in rows])
    beta = np.linalg.lstsq(X, np.array([a[i] for i in rows]), rcond=None)[0]
    for i in (30, 31, 45):
        assert got[i] == pytest.approx(float(np.dot(beta, [1, b[i], b[i - 1], b[i - 7]])), abs=1e-6)


def test_best_lag(series, donors):
    b = noisy(3, 80)
    a = [None] * 3 + [2 * v + 1 for v in b[:-3]]
    best = spatial.best_lag(series(a=a, b=b), donors).collect()
    assert [(r["location"], r["donor"], r["lag"]) for r in best] == [("a", "b", 3)]
    a[50] = None
    filled = spatial.advection(series(a=a, b=b), donors).filter("location = 'a'").orderBy("obs_date").collect()
    assert filled[50]["filled"] == b[47]


def test_tied_lags_keep_the_smaller(series, donors):
    b = [float(i % 2) for i in range(60)]
    assert spatial.best_lag(series(a=b, b=b), donors).first()["lag"] == 0


@pytest.fixture
def written(spark, series):
    """A panel read back from files, which are far smaller than its rows in memory."""
    x = noisy(3, 1501)
    return stored(spark, series(a=[None if i == 700 else v for i, v in enumerate(x[:1500])], b=x[1:]), "panel")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_written_panel_meets_its_donors_without_a_broadcast(written, donors):
    pairs = with_donor(written, donors)
    assert "SortMergeJoin [donor#" in plan_of(pairs) and pairs.count() == 3000


def test_lagged_donors_of_a_written_panel_are_not_broadcast(written, donors):
    lags = spatial.best_lag(written, donors)
    assert "SortMergeJoin [donor#" in plan_of(lags) and [r["lag"] for r in lags.collect()] == [1]


def test_advection_sends_the_lags_to_the_panel(written, donors, column):
    """Before, the panel was the smaller side by its files and went through the driver."""
    out = spatial.advection(written, donors)
    text = plan_of(out)
    assert "BroadcastHashJoin [donor#" in text and "BuildLeft" not in text
    assert column(out, location="a")[700] == noisy(3, 1501)[700]


def test_idw(spark, series, column):
    table = spark.createDataFrame([("a", "b", 10.0), ("a", "c", 30.0)], "target string, donor string, distance_km double")
    pairs = with_donor(series(a=[None, None, None], b=[4, None, None], c=[8, 8, None]), table)
    got = column(spatial.idw(pairs), location="a")
    assert got[0] == pytest.approx((4 / 10 + 8 / 30) / (1 / 10 + 1 / 30)) and got[1] == 8.0 and got[2] is None


def test_knn_by_brute_force(spark, donors):
    rng = np.random.default_rng(5)
    n, k = 150, 5
    day0 = dt.date(2020, 1, 1)
    feats = rng.normal(size=(n, 2))
    y = rng.normal(size=n)
    miss = set(range(0, n, 4))
    rows = [("b", day0 + dt.timedelta(days=i), float(feats[i, 0]), float(feats[i, 1]), None if i % 9 == 0 else float(y[i])) for i in range(n)]
    rows += [("a", day0 + dt.timedelta(days=i), 0.0, 0.0, None if i in miss else 1.0) for i in range(n)]
    wide = spark.createDataFrame(rows, "location string, obs_date date, f1 double, f2 double, y double")
    out = spatial.knn(wide, donors, "y", ["f1", "f2"], k=k, block_days=32).filter("location = 'a'").orderBy("obs_date").collect()
    train = [i for i in range(n) if i % 9]
    for i in miss:
        d = np.array([np.linalg.norm(feats[i] - feats[j]) / 0.95 ** abs(i - j) for j in train])
        pick = np.argsort(d, kind="stable")[:k]
        w = 1 / (d[pick] + 1e-10)
        assert out[i]["filled"] == pytest.approx(float(np.dot(w, y[[train[j] for j in pick]]) / w.sum()), rel=1e-9)


def test_eof_pca_like_numpy(spark):
    rng = np.random.default_rng(2)
    n = 120
    modes = rng.normal(size=(n, 2)) @ rng.normal(size=(2, 6))
    x = modes + 0.01 * rng.normal(size=(n, 6))
    holes = [(10, 2), (11, 0), (11, 5)] + [(20, j) for j in range(4)]
    for i, j in holes:
        x[i, j] = np.nan
    names = [f"c{j}" for j in range(6)]
    rows = [(dt.date(2020, 1, 1) + dt.timedelta(days=i), *[None if np.isnan(v) else float(v) for v in x[i]]) for i in range(n)]
    wide = spark.createDataFrame(rows, "obs_date date, " + ", ".join(f"{c} double" for c in names))
    got = np.array([[r[c] if r[c] is not None else np.nan for c in names] for r in spatial.eof_pca(wide, names).orderBy("obs_date").collect()])
    ok = ~np.isnan(x).any(axis=1)
    mean, std = x[ok].mean(axis=0), x[ok].std(axis=0, ddof=1) + 1e-10
    z = (x[ok] - mean) / std
    vals, vecs = np.linalg.eigh(np.cov(z.T))
    order = np.argsort(vals)[::-1]
    k = int(np.searchsorted(np.cumsum(vals[order]) / vals.sum(), 0.95) + 1)
    P = vecs[:, order[:k]]
    for i in (10, 11):
        known = ~np.isnan(x[i])
        z0 = np.where(known, (x[i] - mean) / std, 0)
        zz = z0
        for _ in range(5):
            zz = np.where(known, z0, P @ (P.T @ zz))
        assert got[i] == pytest.approx(np.where(known, x[i], zz * std + mean), abs=1e-6)
    assert np.isnan(got[20, :4]).all()


def test_gap_ensemble_weights_and_zero_fill(spark, series, donors, column):
    n = 60
    a = [float(i) for i in range(n)]
    b = [2.0 * i for i in range(n)]
    for i in (*range(10, 12), *range(20, 25), *range(35, 50)):
        a[i] = None
    b[21] = None
    got = column(hybrid.gap_ensemble(series(a=a, b=b), donors), location="a")
    krig = column(spatial.kriging(with_donor(series(a=a, b=b), donors)), location="a")
    assert got[10] == pytest.approx(0.8 * 10 + 0.2 * krig[10])
    assert got[22] == pytest.approx(0.5 * 22 + 0.5 * krig[22])
    assert got[40] == pytest.approx(0.3 * 40 + 0.7 * krig[40])
    assert got[21] == pytest.approx(21.0)
    zero = column(hybrid.gap_ensemble(series(a=a, b=b), donors, zero_fill=True), location="a")
    assert zero[21] == pytest.approx(0.5 * 21)


def test_sequential_regresses_where_interpolation_cannot(series, donors, column):
    b = noisy(4, 60)
    a = [2 * v if i >= 20 else None for i, v in enumerate(b)]
    got = column(hybrid.sequential(series(a=a, b=b), donors), location="a")
    assert got[:7] == [None] * 7
    assert got[7:20] == pytest.approx([2 * v for v in b[7:20]])


def test_every_registered_method_runs_and_the_chain_leaves_nothing(series, donors):
    v = series(variable="v", a=noisy(6, 60, holes=range(20, 30)), b=noisy(7, 60))
    df = v.union(series(variable="w", a=noisy(8, 60), b=noisy(9, 60)))
    matrix = (["a", "b"], ["v", "w"])
    assert set(hybrid.registry(donors, matrix)) == set(hybrid.METHODS)
    for name, method in hybrid.registry(donors, matrix).items():
        rows = method(df).select("value", "filled").collect()
        assert len(rows) == 240 and all(r["filled"] == r["value"] for r in rows if r["value"] is not None), name
    rows = hybrid.impute(df, "cross_knn", donors, matrix).select("filled").collect()
    assert len(rows) == 240 and all(r["filled"] is not None for r in rows)


def test_cross_variable_uses_the_leading_modes(series, donors, column):
    base = noisy(6, 60)
    v = series(variable="v", a=[None if 20 <= i < 30 else x for i, x in enumerate(base)], b=[2 * x for x in base])
    df = v.union(series(variable="w", a=[3 * x + 1 for x in base], b=[-x for x in base]))
    out = hybrid.dispatch(df, donors, "cross_variable", (["a", "b"], ["v", "w"]))
    got = column(out, location="a", variable="v")
    # One mode explains everything; five rounds close 1 - (1/4)^5 of the distance.
    assert got[25] == pytest.approx(base[25], rel=0.05, abs=0.05)


@pytest.mark.parametrize("pattern", ["random_10", "block_7day", "seasonal", "rolling_origin", "anything"])
def test_dispatch_returns_the_whole_panel(series, donors, pattern):
    df = series(a=noisy(6, 60, holes=range(20, 30)), b=noisy(7, 60))
    out = hybrid.dispatch(df, donors, pattern)
    assert out.filter(F.col("location") == "a").count() == 60
    assert set(df.columns) | {"filled"} == set(out.columns)
