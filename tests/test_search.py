import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lacuna.operators import search
from lacuna.session import fresh_path

FAST = {"n_estimators": 2, "max_depth": 2}


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(240, 2))
    data = [(i, i % 2 + 1, "train" if i < 160 else "test", float(a), float(b), int(a + 0.1 * b > 0)) for i, (a, b) in enumerate(x)]
    return spark.createDataFrame(data, "id int, split_num int, role string, a double, b double, label int").cache()


def _run(rows, ledger, draws, splits=(1, 2)):
    return search.search(rows.filter("role = 'train'"), ["a", "b"], "label", ledger, splits, draws, folds=2, row_key=("id",))


def test_draws_are_repeatable_points_of_the_whole_space():
    draws = search.draw_params()
    assert draws == search.draw_params() and len(draws) == 20 and set(draws[0]) == set(search.SPACE)
    assert all(d[k] in v for d in draws for k, v in search.SPACE.items())
    assert len({json.dumps(d) for d in draws}) == 20
    assert len(search.draw_params(99, space={"x": (1, 2), "y": (3,)})) == 2


def test_a_broken_run_goes_on(spark, rows):
    ledger = search.Ledger(spark, fresh_path(spark, "ledger"))
    assert ledger.entries().count() == 0
    draws = [d | FAST for d in search.draw_params(2)]
    assert _run(rows, ledger, draws[:1], splits=(1,)) == 2  # broken off here
    assert _run(rows, ledger, draws) == 6
    assert _run(rows, search.Ledger(spark, ledger.path), draws) == 0
    got = search.report(ledger).collect()
    assert len(got) == 4 and {r.folds for r in got} == {2} and sum(r.is_best for r in got) == 2
    assert all(r.mean_auc > 0.8 for r in got)


def test_winners_refit_and_scores(spark, rows):
    ledger = search.Ledger(spark, fresh_path(spark, "ledger"))
    draws = [d | FAST for d in search.draw_params(2)]
    for split, draw, fold, auc in ((1, 0, 0, 0.6), (1, 0, 1, 0.8), (1, 1, 0, 0.9), (1, 1, 1, 0.4), (2, 0, 0, 0.5), (2, 1, 0, 0.5)):
        ledger.add(split, draw, fold, draws[draw], auc)
    won = {r.split_num: r for r in search.winners(ledger).collect()}
    assert won[1].draw == 0 and won[1].mean_auc == pytest.approx(0.7) and won[2].draw == 0
    out = search.scored_splits(rows, ["a", "b"], "label", ledger)
    assert out.count() == 80 and out.filter(~F.col("prob").between(0, 1)).count() == 0
    table = spark.createDataFrame([(1, 0.7), (2, None)], "split_num int, auc double")
    model, params = search.refit(rows, ["a", "b"], "label", ledger, table)
    assert params == draws[0]
    top = search.top_importance(spark, model, ["a", "b"], 1).collect()
    assert [(r["rank"], r.feature) for r in top] == [(1, "a")]


def test_one_class_in_a_fold(spark, rows):
    ledger = search.Ledger(spark, fresh_path(spark, "ledger"))
    same = rows.withColumn("label", F.lit(1))
    assert search.search(same, ["a", "b"], "label", ledger, (1,), [search.draw_params(1)[0] | FAST], 2, ("id",)) == 2
    assert [r.auc for r in ledger.entries().collect()] == [0.5, 0.5]
