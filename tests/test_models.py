import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from lacuna.operators import models, spatial


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 2))
    y = 3 * x[:, 0] + 0.05 * rng.normal(size=300)
    data = [(i, float(a), float(b), float(t), int(t > 0), i % 5 == 0) for i, ((a, b), t) in enumerate(zip(x, y))]
    return spark.createDataFrame(data, "id int, a double, b double, y double, label int, is_validation boolean").cache()


def test_context_regression_like_least_squares(rows):
    holed = rows.withColumn("y", F.when(F.col("id") % 7 != 0, F.col("y")))
    got = {r["id"]: r["filled"] for r in spatial.gradient_regression(holed, "y", ["a", "b"]).collect()}
    data = rows.collect()
    known = [r for r in data if r["id"] % 7]
    X = np.array([[1, r["a"], r["b"]] for r in known])
    beta = np.linalg.lstsq(X, np.array([r["y"] for r in known]), rcond=None)[0]
    for r in data:
        want = r["y"] if r["id"] % 7 else float(np.dot(beta, [1, r["a"], r["b"]]))
        assert got[r["id"]] == pytest.approx(want, abs=1e-6)


def test_regression_needs_enough_rows(rows):
    few = rows.limit(10).withColumn("y", F.when(F.col("id") > 2, F.col("y")))
    assert spatial.gradient_regression(few, "y", ["a", "b"]).filter("y is null and filled is not null").count() == 0


def test_boosting_learns_the_signal_and_ranks_features(spark, rows):
    model = models.fit_regressor(rows, ["a", "b"], "y", "is_validation", rounds=15)
    scored = models.predict(model, rows, ["a", "b"])
    assert scored.select(F.corr("y", "prediction")).first()[0] > 0.9
    share = {r["feature"]: r["importance"] for r in models.importance(spark, model, ["a", "b"]).collect()}
    assert share["a"] > share["b"] and sum(share.values()) == pytest.approx(1.0)


def test_random_search_reports_every_draw(spark, rows):
    report = models.search_report(spark, models.random_search(rows, ["a", "b"], "label", draws=2, folds=2, rounds=2)).collect()
    assert len(report) == 2 and sum(r["is_best"] for r in report) >= 1 and min(r["mean_auc"] for r in report) > 0.8


def test_fits_of_a_search_share_no_local_properties(spark, rows, monkeypatch):
    """Query ids are local properties: threads that share them overwrite each other's (a fit then failed on a null id)."""
    seen, fit = [], models.GBTClassifier._fit

    def watched(self, dataset):
        held = spark.sparkContext._jsc.sc().getLocalProperties()
        seen.append((spark._jvm.System.identityHashCode(held), threading.get_ident()))
        return fit(self, dataset)

    monkeypatch.setattr(models.GBTClassifier, "_fit", watched)
    found = models.random_search(rows, ["a", "b"], "label", draws=4, folds=2, rounds=1)
    owners = {}
    for held, thread in seen:
        owners.setdefault(held, set()).add(thread)
    assert len(seen) == 9 and all(len(threads) == 1 for threads in owners.values())
    assert len(found.avgMetrics) == 4 and min(found.avgMetrics) > 0.8


def test_a_row_without_a_label_takes_no_part_in_a_search(rows):
    """Spark's trees refuse it."""
    holed = rows.withColumn("label", F.when(F.col("id") % 50 != 0, F.col("label")))
    found = models.random_search(holed, ["a", "b"], "label", draws=1, folds=2, rounds=1)
    assert min(found.avgMetrics) > 0.8


def test_methods_are_scored_per_split(rows):
    split = rows.withColumn("split_num", F.lit(1)).withColumn("role", F.when(F.col("id") < 200, "train").otherwise("test"))
    out = models.evaluate_methods([1], {"plain": lambda a, b: (a, b)}, split, ["a", "b"], "label", rounds=2).collect()
    assert [(r["name"], r["split_num"], r["n"]) for r in out] == [("plain", 1, 100)] and out[0]["auc"] > 0.9
