import numpy as np
import pytest

from lacuna.operators import hybrid, joint, spatial
from lacuna.operators.panel import with_donor


def noisy(seed, n=80, holes=()):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=n).cumsum().round(3)
    return [None if i in holes else float(v) for i, v in enumerate(x)]


@pytest.fixture(scope="module")
def three(spark):
    rows = [("a", "d", 30.0), ("a", "b", 10.0), ("a", "c", 20.0), ("b", "c", 5.0)]
    return spark.createDataFrame(rows, "target string, donor string, distance_km double")


@pytest.fixture(scope="module")
def sites():
    return {"a": noisy(1, holes=(20, 21, 40, 60)), "b": noisy(2, holes=(41, 60)), "c": noisy(3), "d": noisy(4)}


def columns(sites, lags=(0,)):
    out = []
    for s in "bcd":
        for k in lags:
            out.append([None] * k + sites[s][: len(sites[s]) - k])
    return [list(r) for r in zip(*out, strict=True)]


def test_regression_like_least_squares(series, three, sites, column):
    lags = (0, 1, 7)
    got = column(joint.regression(series(**sites), three, lags), location="a")
    x = columns(sites, lags)
    rows = [i for i in range(80) if sites["a"][i] is not None and None not in x[i]]
    beta = np.linalg.lstsq(np.array([[1, *x[i]] for i in rows]), np.array([sites["a"][i] for i in rows]), rcond=None)[0]
    for i in (20, 21, 40, 60):
        if None in x[i]:
            assert got[i] is None
        else:
            assert got[i] == pytest.approx(float(np.dot(beta, [1, *x[i]])), abs=1e-6)
    assert got[60] is None and got[40] is not None


def test_kriging_weights_solve_the_donors_covariances(series, three, sites, column):
    got = column(joint.kriging(series(**sites), three), location="a")
    x = columns(sites)
    rows = [i for i in range(80) if sites["a"][i] is not None and None not in x[i]]
    z, y = np.array([x[i] for i in rows]), np.array([sites["a"][i] for i in rows])
    cov = np.cov(z.T, bias=True)
    w = np.linalg.solve(cov, ((z - z.mean(0)) * (y - y.mean())[:, None]).sum(0) / (len(y) - 1))
    assert got[20] == pytest.approx(float(y.mean() + w @ (np.array(x[20]) - z.mean(0))), abs=1e-6)


def test_one_row_per_cell(series, three, sites):
    frame = series(**sites)
    n = frame.count()
    for made in (
        joint.regression(frame, three), joint.kriging(frame, three), spatial.advection(frame, three), hybrid.sequential(frame, three),
        hybrid.gap_ensemble(frame, three), hybrid.dispatch(frame, three, "block_7day"), hybrid.dispatch(frame, three, "seasonal"),
    ):
        assert made.count() == n and set(frame.columns) | {"filled"} == set(made.columns)


def test_one_donor_equals_the_pair_models(spark, series, sites, column):
    one = spark.createDataFrame([("a", "c", 20.0)], "target string, donor string, distance_km double")
    frame = series(**sites)
    for a, b in (
        (joint.kriging(frame, one), spatial.kriging(with_donor(frame, one))),
        (joint.regression(frame, one), spatial.regression3(spatial.with_donor_lags(frame, one, (1, 7)))),
        (hybrid.sequential(frame, one), hybrid.sequential(frame, one, single=True)),
        (hybrid.gap_ensemble(frame, one), hybrid.gap_ensemble(frame, one, single=True)),
    ):
        x, y = column(a, location="a"), column(b, location="a")
        assert [v is None for v in x] == [v is None for v in y]
        assert [v for v in x if v is not None] == pytest.approx([v for v in y if v is not None], abs=1e-7)


def test_donors_that_repeat_or_do_not_vary_have_no_weight(spark, series, column):
    b = noisy(5)
    a = [None if i in (30, 50) else 2 * v + 1 for i, v in enumerate(b)]
    table = spark.createDataFrame([("a", s, float(k)) for k, s in enumerate("bcd")], "target string, donor string, distance_km double")
    frame = series(a=a, b=b, c=b, d=[4.0] * 80)
    for made in (joint.regression(frame, table, (0,)), joint.kriging(frame, table, min_pairs=20)):
        got = column(made, location="a")
        assert got[30] == pytest.approx(2 * b[30] + 1, rel=0.03) and got[50] is not None


def test_too_few_days_and_no_donors(spark, series, column, three):
    frame = series(a=[1.0, None, 2.0], b=[1.0, 2.0, 3.0], c=[2.0, 1.0, 1.0], d=[0.0, 1.0, 5.0], e=[None, 1.0, None])
    for made in (joint.regression(frame, three), joint.kriging(frame, three), joint.kriging(frame, three.limit(0))):
        assert column(made, location="a") == [1.0, None, 2.0] and column(made, location="e") == [None, 1.0, None]


def test_many_donors(spark, series, column):
    names = [f"s{k:02d}" for k in range(12)]
    values = {s: noisy(50 + k, 200) for k, s in enumerate(names)}
    weights = np.arange(12) / 7 - 0.5
    target = [float(sum(w * values[s][i] for w, s in zip(weights, names, strict=True))) + 3 for i in range(200)]
    target[77] = None
    table = spark.createDataFrame([("zz", s, float(k)) for k, s in enumerate(names)], "target string, donor string, distance_km double")
    got = column(joint.regression(series(zz=target, **values), table, (0,)), location="zz")
    assert got[77] == pytest.approx(float(sum(w * values[s][77] for w, s in zip(weights, names, strict=True))) + 3, abs=1e-6)
