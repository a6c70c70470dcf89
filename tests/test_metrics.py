import numpy as np
import pytest
from pyspark.sql import functions as F

from lacuna.functions.scan import exact_quantiles, hash_rank, running_totals
from lacuna.operators import ensemble, metrics, reports


@pytest.fixture(scope="module")
def scored(spark):
    """Two groups; heavy ties: a third of all rows share one score."""
    rng = np.random.default_rng(0)
    rows = []
    for g, n in (("big", 900), ("small", 40)):
        p = rng.random(n).round(3 if g == "big" else 1)
        p[: n // 3] = 0.5
        y = (rng.random(n) < 0.3 + 0.4 * p).astype(int)
        rows += [(g, int(a), float(b)) for a, b in zip(y, p)]
    return rows, spark.createDataFrame(rows, "g string, label int, prob double").cache()


def brute_auc(rows, g):
    pos = np.array([p for k, y, p in rows if k == g and y == 1])
    neg = np.array([p for k, y, p in rows if k == g and y == 0])
    return ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))


def test_auc_with_ties(scored):
    rows, df = scored
    got = {r["g"]: r["auc"] for r in metrics.roc_auc(df, ["g"]).collect()}
    assert got == pytest.approx({g: brute_auc(rows, g) for g in ("big", "small")})


def test_auc_of_one_class_is_null(spark):
    df = spark.createDataFrame([("a", 1, 0.3), ("a", 1, 0.6)], "g string, label int, prob double")
    assert metrics.roc_auc(df, ["g"]).first()["auc"] is None


def macro_f1(y, pred):
    out = []
    for c in (1, 0):
        tp = ((y == c) & (pred == c)).sum()
        d = 2 * tp + ((y != c) & (pred == c)).sum() + ((y == c) & (pred != c)).sum()
        out.append(2 * tp / d if d else 0.0)
    return sum(out) / 2


def test_best_threshold_by_brute_force(scored):
    rows, df = scored
    got = {r["g"]: (r["threshold"], r["macro_f1"]) for r in metrics.best_threshold(df, ["g"], clip=(0.0, 1.0)).collect()}
    for g in ("big", "small"):
        y = np.array([a for k, a, _ in rows if k == g])
        p = np.array([b for k, _, b in rows if k == g])
        best = max((macro_f1(y, (p >= t).astype(int)), t) for t in set(p))
        assert got[g] == pytest.approx((best[1], best[0]))


def test_threshold_is_clipped_and_falls_back(spark):
    df = spark.createDataFrame([("a", 1, 0.9), ("a", 0, 0.8), ("b", 1, 0.2)], "g string, label int, prob double")
    got = {r["g"]: r["threshold"] for r in metrics.best_threshold(df, ["g"]).collect()}
    assert got == {"a": 0.5, "b": 0.5}


def test_binary_scores_of_missing_probabilities(spark):
    df = spark.createDataFrame(
        [("a", 1, None), ("a", 0, 0.2), ("b", 1, None), ("b", 0, None)], "g string, label int, prob double"
    )
    got = {r["g"]: r for r in metrics.binary_scores(df, ["g"]).collect()}
    assert (got["a"]["accuracy"], got["a"]["precision"], got["a"]["auc"]) == (1.0, 1.0, 1.0)
    assert got["b"]["accuracy"] is None and got["b"]["auc"] is None and got["b"]["f1"] is None


def test_fill_scores_report_coverage(spark):
    df = spark.createDataFrame([("m", 1.0, 2.0), ("m", 3.0, 3.0), ("m", 5.0, None), ("c", 2.0, 2.5)], "k string, truth double, filled double")
    got = {r["k"]: r for r in metrics.fill_scores(df, ["k"]).collect()}
    m = got["m"]
    assert (m["missing_count"], m["filled_count"]) == (3, 2) and m["coverage"] == pytest.approx(2 / 3)
    assert m["rmse"] == pytest.approx(0.5**0.5) and m["mae"] == 0.5 and m["r2"] == pytest.approx(0.5)
    assert got["c"]["r2"] is None


@pytest.mark.parametrize("pieces", [2, 16, 256])
def test_running_totals_do_not_depend_on_the_cuts(spark, pieces):
    df = spark.range(500).select((F.col("id") % 2).alias("g"), (F.col("id") * F.col("id") % 997).cast("double").alias("x"), F.lit(1).alias("n"))
    one = df.groupBy("g", "x").agg(F.sum("n").alias("n"))
    out = running_totals(one, ["g"], "x", ["n"], pieces)
    rows = out.orderBy("g", "x").collect()
    total = {}
    for r in rows:
        total[r["g"]] = total.get(r["g"], 0) + r["n"]
        assert r["n_upto"] == total[r["g"]] and r["n_all"] == 250


def test_exact_quantiles_like_numpy(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=301), np.full(150, 0.25)])
    df = spark.createDataFrame([("a", float(v)) for v in x] + [("b", 7.0)], "g string, x double")
    got = {r["g"]: r for r in exact_quantiles(df, ["g"], "x", {"q1": 0.25, "med": 0.5, "p9": 0.9}).collect()}
    assert [got["a"][k] for k in ("q1", "med", "p9")] == pytest.approx(np.quantile(x, [0.25, 0.5, 0.9]).tolist())
    assert got["b"]["med"] == 7.0


def test_hash_rank_is_a_dense_order(spark):
    df = spark.range(300).select((F.col("id") % 3).alias("g"), F.md5(F.col("id").cast("string")).alias("h"))
    rows = hash_rank(df, ["g"], "h", digits=1).orderBy("g", "h").collect()
    assert [r["_rank"] for r in rows] == list(range(1, 101)) * 3 and {r["_all"] for r in rows} == {100}


def test_rank_min_leaves_missing_unranked(spark):
    meta = spark.createDataFrame([(x,) for x in "abcd"], "method_name string")
    down = spark.createDataFrame([("a", 0.6), ("b", 0.6), ("d", 0.7)], "method_name string, auc double")
    scores = spark.createDataFrame([("a", 1.0)], "method_name string, rmse double")
    later = spark.createDataFrame([("a", 9.0), ("b", 2.0)], "method_name string, rmse double")
    got = {r["method_name"]: r for r in reports.master_comparison(meta, [scores, later], down).collect()}
    assert {k: v["auc_rank"] for k, v in got.items()} == {"a": 2, "b": 2, "c": None, "d": 1}
    assert got["a"]["rmse"] == 1.0 and got["b"]["rmse"] == 2.0
    notes = {r["message"] for r in reports.missing_metric_report(reports.master_comparison(meta, [scores, later], down)).collect()}
    assert "Missing imputation metrics for method: d" in notes and "Missing downstream metrics for method: c" in notes


def test_method_names(spark):
    df = spark.createDataFrame([(" Cross-Location Regression ",), ("Hybrid: A → B",), ("x",)], "n string")
    got = [r[0] for r in df.select(reports.method_name("n")).collect()]
    assert got == ["Cross-Location Linear Regression", "Hybrid: A -> B", "x"]


def test_best_per_pattern_keeps_patterns_without_scores(spark):
    df = spark.createDataFrame(
        [("seasonal", "m", None, 1.0, 1.0), ("block_7day", "b", 1.0, 1.0, 1.0), ("block_7day", "a", 1.0, 1.0, 1.0), ("new", "z", 3.0, 1.0, 1.0)],
        "mask_type string, method_name string, rmse double, mae double, r2 double",
    )
    got = {r["mask_type"]: (r["method_name"], r["rmse"], r["pattern_order"]) for r in reports.best_per_pattern(df).collect()}
    assert got == {"seasonal": (None, None, 5), "block_7day": ("a", 1.0, 1), "new": ("z", 3.0, 999)}


@pytest.fixture(scope="module")
def votes(spark):
    rows = [(1, 1, 1, "m1", 0.2), (1, 1, 1, "m2", 0.8), (1, 2, 0, "m1", 0.4), (1, 2, 0, "m2", None), (2, 3, 1, "m1", 0.9), (2, 3, 1, "m2", None)]
    return spark.createDataFrame(rows, "split_num int, sample_id long, label int, model string, prob double")


def by_sample(df):
    return {r["sample_id"]: r["prob"] for r in df.collect()}


def test_soft_vote_ignores_and_weights_propagate_missing(spark, votes):
    assert by_sample(ensemble.soft_vote(votes)) == pytest.approx({1: 0.5, 2: 0.4, 3: 0.9})
    w = spark.createDataFrame([("m1", 3.0), ("m2", 1.0)], "model string, weight double")
    got = by_sample(ensemble.weighted(votes, w))
    assert got[1] == pytest.approx(0.35) and got[2] is None and got[3] == pytest.approx(0.9)


@pytest.mark.parametrize("w1,w2,want", [(-1.0, 2.0, 0.8), (None, 1.0, 0.5), (0.0, 0.0, 0.5), (-1.0, 0.0, 0.5)])
def test_odd_weights(spark, votes, w1, w2, want):
    w = spark.createDataFrame([("m1", w1), ("m2", w2)], "model string, weight double")
    assert by_sample(ensemble.weighted(votes, w))[1] == pytest.approx(want)


def test_stacking_falls_back_to_the_vote(votes):
    got = by_sample(ensemble.stacked(votes, ["m1", "m2"], [1, 2]))
    # Without split 1 only positives remain, so split 1 is voted on.
    assert got[1] == pytest.approx(0.5) and got[2] == pytest.approx(0.4)
    assert 0 < got[3] < 1


def test_stacking_learns_a_useful_model(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(240):
        y = int(rng.random() < 0.4)
        rows.append((i % 3, i, y, "good", float(np.clip(0.5 + (y - 0.5) * 0.6 + rng.normal() * 0.1, 0, 1))))
        rows.append((i % 3, i, y, "noise", float(rng.random())))
    df = spark.createDataFrame(rows, "split_num int, sample_id long, label int, model string, prob double")
    out = ensemble.stacked(df, ["good", "noise"], [0, 1, 2])
    assert out.count() == 240
    assert min(r["auc"] for r in metrics.roc_auc(out, ["split_num"]).collect()) > 0.95


def test_class_weights(spark):
    df = spark.createDataFrame([("a", 1)] + [("a", 0)] * 3 + [("b", 0)] * 2, "g string, label int")
    got = {r["g"]: r for r in metrics.class_weights(df, ["g"]).collect()}
    assert (got["a"]["weight_0"], got["a"]["weight_1"], got["a"]["pos_weight"]) == pytest.approx((4 / 6, 2.0, 3.0))
    assert got["b"]["weight_1"] is None and got["b"]["pos_weight"] == 2.0


def test_split_summary_counts_and_orders(spark):
    rows = [("x", 1, 0.5, 0.1), ("x", 2, 0.7, 0.3), ("y", 1, 0.9, 0.2), ("z", 1, None, 0.9)]
    df = spark.createDataFrame(rows, "m string, split_num int, auc double, f1 double")
    out = reports.split_summary(df, "m", ("auc", "f1"), [F.col("auc_mean").desc_nulls_last()])
    got = {r["m"]: (r["rank"], r["n_splits"], r["auc_std"]) for r in out.collect()}
    assert got["y"][0] == 1 and got["x"] == (2, 2, pytest.approx(0.1414213562)) and got["z"][0] == 3 and got["y"][2] is None


def test_rounding_moves_exact_halves_only(spark):
    import random

    from lacuna.plans.common import rr

    rng = random.Random(3)
    values = [rng.random() for _ in range(2000)]
    rows = rr(spark.createDataFrame([(v, v) for v in values], "v double, x double"), "x", digits=6).collect()
    assert all(r["x"] == round(r["v"], 6) for r in rows if abs(r["v"] * 1e6 % 1 - 0.5) > 2e-4)
