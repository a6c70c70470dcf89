import datetime as dt

import numpy as np
import pytest

from lacuna.operators import modes


def by_numpy(x, share=0.95, rounds=5):
    """Rows are days, columns series, nan is missing."""
    full = x[~np.isnan(x).any(1)]
    mean, std = full.mean(0), full.std(0, ddof=1) + 1e-10
    z = (full - mean) / std
    values, vectors = np.linalg.eigh(np.cov(z.T))
    values, vectors = values[::-1], vectors[:, ::-1]
    v = vectors[:, : int(np.searchsorted(np.cumsum(values) / values.sum(), share)) + 1]
    known = ~np.isnan(x)
    start = np.where(known, (x - mean) / std, 0.0)
    now = start
    for _ in range(rounds):
        now = np.where(known, start, now @ v @ v.T)
    some = (known.sum(1) * 2 >= x.shape[1])[:, None]
    return np.where(known, x, np.where(some, now * std + mean, np.nan))


def table(spark, x):
    day0 = dt.date(2020, 1, 1)
    rows = [(f"s{j:03d}", "v", day0 + dt.timedelta(days=i), None if np.isnan(v) else float(v)) for i, r in enumerate(x) for j, v in enumerate(r)]
    return spark.createDataFrame(rows, "location string, variable string, obs_date date, value double")


def matrix(spark_rows, shape):
    out = np.full(shape, np.nan)
    day0 = dt.date(2020, 1, 1)
    for r in spark_rows:
        if r.filled is not None:
            out[(r.obs_date - day0).days, int(r.location[1:])] = r.filled
    return out


def signals(days, series, ranks, noise, seed):
    rng = np.random.default_rng(seed)
    scale = 3.0 ** -np.arange(ranks)
    x = rng.normal(size=(days, ranks)) * scale @ rng.normal(size=(ranks, series)) + noise * rng.normal(size=(days, series))
    return x * rng.uniform(1, 5, series) + rng.uniform(-3, 3, series), rng


@pytest.mark.parametrize(("series", "block"), [(6, 16), (40, 8)])
def test_like_numpy(spark, series, block):
    x, rng = signals(120, series, 4, 0.02, series)
    hole = rng.random(x.shape) < 0.1
    hole[:60] = False
    hole[100, :] = True
    hole[100, : series // 3] = False
    x[hole] = np.nan
    got = matrix(modes.eof_fill(table(spark, x), block=block).collect(), x.shape)
    want = by_numpy(x)
    assert (np.isnan(got) == np.isnan(want)).all() and np.isnan(want).any()
    np.testing.assert_allclose(got[~np.isnan(want)], want[~np.isnan(want)], atol=1e-5)


def test_block_grows_until_the_share_is_held(spark):
    x, _ = signals(200, 8, 8, 1.0, 3)
    x[50, 2] = np.nan
    got = matrix(modes.eof_fill(table(spark, x), block=4).collect(), x.shape)
    np.testing.assert_allclose(got[50, 2], by_numpy(x)[50, 2], atol=1e-5)


def test_too_few_whole_days_and_rows_without_a_place(spark):
    x, _ = signals(12, 3, 2, 0.1, 5)
    x[3:, 0] = np.nan
    assert modes.eof_fill(table(spark, x)).filter("value IS NULL AND filled IS NOT NULL").count() == 0
    empty = spark.createDataFrame([], "location string, variable string, obs_date date, value double")
    assert modes.eof_fill(empty).count() == 0
    y, _ = signals(30, 3, 2, 0.1, 6)
    y[4, 1] = np.nan
    extra = spark.createDataFrame([(None, "v", dt.date(2020, 1, 2), 5.0), ("s001", "v", None, None)], empty.schema)
    out = modes.eof_fill(table(spark, y).union(extra))
    assert out.count() == 92 and out.filter("value IS NULL AND filled IS NOT NULL").count() == 1
