import datetime as dt

import pytest
from pyspark.sql import functions as F

from lacuna.operators import masking, splits


def dates(rows):
    return [str(r["cutoff"]) for r in rows]


@pytest.mark.parametrize(
    "window,cutoffs",
    [
        (90, ["2019-10-02", "2020-07-02", "2021-04-02", "2022-01-01"]),
        (180, ["2019-09-14", "2020-05-27", "2021-02-07", "2021-10-21"]),
    ],
)
def test_split_dates(spark, window, cutoffs):
    lo, hi = F.lit("2019-01-01").cast("date"), F.lit("2022-12-31").cast("date")
    rows = spark.range(1).select(F.inline(splits.rolling_splits(None, splits.RollingOrigin(window, 4), (lo, hi)))).collect()
    assert dates(rows) == cutoffs
    assert all((r["test_end"] - r["test_start"]).days == window - 1 for r in rows)


@pytest.fixture(scope="module")
def baseline(spark):
    """2 sites x 1,461 days; v1 complete, v2 mostly missing."""
    days = F.explode(F.sequence(F.lit("2019-01-01").cast("date"), F.lit("2022-12-31").cast("date")))
    base = spark.createDataFrame([("a",), ("b",)], "location string").select("location", days.alias("obs_date"))
    one = base.withColumn("variable", F.lit("v1")).withColumn("value", F.dayofyear("obs_date").cast("double"))
    sparse = F.when((F.datediff("obs_date", F.lit("2019-01-01").cast("date")) % 24 == 0), F.lit(1.0))
    return one.union(base.withColumn("variable", F.lit("v2")).withColumn("value", sparse)).cache()


def masked(df):
    return df.filter("is_masked").groupBy("variable").count().collect()


def counts(df):
    return {r["variable"]: r["count"] for r in masked(df)}


def test_random_counts(baseline):
    assert counts(masking.Strategy("random_10").apply(baseline)) == {"v1": 292, "v2": int(122 * 0.10)}
    assert counts(masking.Strategy("random_20").apply(baseline))["v1"] == 584


@pytest.mark.parametrize("name", ["block_7day", "block_14day"])
def test_block_counts(baseline, name):
    assert counts(masking.Strategy(name).apply(baseline)) == {"v1": 112, "v2": 112}


def test_rolling_counts_and_rate_over_hundred(baseline):
    m = masking.Strategy("rolling_origin").apply(baseline)
    per = {r["split_num"]: r["n"] for r in m.filter("is_masked").groupBy("split_num").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert per == {k: 360 for k in (1, 2, 3, 4)}
    stats = {(r["split_num"], r["variable"]): r for r in masking.mask_stats(m, ["split_num"]).collect()}
    row = stats[(2, "v2")]
    assert row["originally_missing"] == 2922 - 122 and row["masked_rate_pct"] == pytest.approx(147.54)
    assert stats[(2, None)]["masked_cells"] == 360


def test_cross_variable_counts(baseline):
    s = masking.Strategy("cross_variable", {"variables": ("v1",), "periods": (("2020-06-01", "2020-06-30"), ("2021-08-01", "2021-09-15"))})
    assert counts(s.apply(baseline)) == {"v1": 152}


def test_seasonal_pools(baseline):
    m = masking.Strategy("seasonal").apply(baseline).filter("variable = 'v1' and is_masked")
    wet = m.filter(F.month("obs_date").between(6, 10)).count()
    assert wet == int(2 * 4 * 153 * 0.4) and m.count() - wet == int((2922 - 2 * 4 * 153) * 0.1)


def test_mask_is_independent_of_partitioning(baseline):
    for name in ("random_10", "block_7day", "seasonal"):
        pick = lambda d: {(r[0], r[1], r[2]) for r in masking.Strategy(name).apply(d).filter("is_masked").select("location", "variable", "obs_date").collect()}  # noqa: E731,B023
        assert pick(baseline) == pick(baseline.repartition(17))


def test_random_mask_hits_observed_cells_only_and_apply_keeps_truth(baseline):
    m = masking.apply_mask(masking.Strategy("random_10").apply(baseline))
    assert m.filter("is_masked and truth is null").count() == 0
    assert m.filter("is_masked and value is not null").count() == 0
    assert m.filter("not is_masked and not (value <=> truth)").count() == 0


def test_date_index_splits_by_brute_force(spark):
    day0 = dt.date(2019, 1, 1)
    all_days = [day0 + dt.timedelta(days=2 * i) for i in range(40)]
    df = spark.createDataFrame([(d,) for d in all_days] * 2, "obs_date date")
    got = {r["split_num"]: (r["cutoff"], r["test_start"], r["test_end"]) for r in splits.date_index_splits(df, 6, 10, 27).collect()}
    want = {}
    for k in range(1, 7):
        end = len(all_days) - k
        start = end - 9
        if start - 1 >= 27:
            want[k] = (all_days[start - 1], all_days[start], all_days[end])
    assert got == want and sorted(got) == [1, 2, 3]


def test_inner_validation_share(spark):
    df = spark.createDataFrame([("s", dt.date(2020, 1, 1) + dt.timedelta(days=i)) for i in range(11)], "g string, obs_date date")
    out = splits.inner_validation(df, 0.8, ["g"])
    assert out.filter("is_validation").count() == 3
    assert out.filter("is_validation").agg(F.min("obs_date")).first()[0] == dt.date(2020, 1, 9)
