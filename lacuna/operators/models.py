"""Boosted trees on the feature matrix.

Gradient-boosted trees of Spark ML stand in for the study's boosting library: same
depth, rate and sampling, so scores are comparable but not equal.
"""

from __future__ import annotations

import random
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import partial

from pyspark import inheritable_thread_target
from pyspark.ml import Model
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Training parameters and the search space.
GBT_PARAMS = {"maxDepth": 6, "stepSize": 0.05, "subsamplingRate": 0.8, "featureSubsetStrategy": "0.8"}
ROUNDS = 500
SEARCH_SPACE = {"maxDepth": (3, 4, 5, 6), "stepSize": (0.01, 0.05, 0.1), "subsamplingRate": (0.7, 0.8, 0.9)}


def assemble(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep").transform(df)


def fit_regressor(train: DataFrame, features: Sequence[str], label: str, validation: str | None = None, rounds: int = ROUNDS, seed: int = 42):
    """Boosted regression; with ``validation`` (a boolean column) it stops early."""
    gbt = GBTRegressor(featuresCol="features", labelCol=label, maxIter=rounds, seed=seed, **GBT_PARAMS)
    if validation:
        gbt = gbt.setValidationIndicatorCol(validation)
    return gbt.fit(assemble(train, features))


def predict(model, df: DataFrame, features: Sequence[str]) -> DataFrame:
    return model.transform(assemble(df, features)).drop("features")


def positive_probability(model, df: DataFrame, features: Sequence[str]) -> DataFrame:
    scored = model.transform(assemble(df, features))
    return scored.withColumn("prob", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def fit_classifier(train: DataFrame, features: Sequence[str], label: str, weight: str | None = None, rounds: int = ROUNDS, seed: int = 42):
    gbt = GBTClassifier(featuresCol="features", labelCol=label, maxIter=rounds, seed=seed, **GBT_PARAMS)
    if weight:
        gbt = gbt.setWeightCol(weight)
    return gbt.fit(assemble(train, features))


@dataclass(frozen=True)
class Searched:
    """What a search found, by the names that Spark's cross validation gives it."""

    bestModel: Model
    avgMetrics: list[float]
    paramMaps: list[dict]

    def getEstimatorParamMaps(self) -> list[dict]:
        return self.paramMaps


def random_search(
    train: DataFrame, features: Sequence[str], label: str, draws: int = 20, folds: int = 3, rounds: int = 100,
    parallelism: int = 4, seed: int = 42,
) -> Searched:
    """Random draws from the search space, cross-validated by AUC; candidates train in parallel.

    Spark's ``CrossValidator`` hands one object of local properties to all its threads, where the
    ids of their queries overwrite each other and a fit may find none. Here every fit has a copy of its own.
    Folds are dealt as there, once for all fits. Rows without a label take no part.
    """
    spark = train.sparkSession
    rng = random.Random(seed)
    gbt = GBTClassifier(featuresCol="features", labelCol=label, maxIter=rounds, seed=seed)
    maps = [{getattr(gbt, k): rng.choice(v) for k, v in SEARCH_SPACE.items()} for _ in range(draws)]
    scorer = BinaryClassificationEvaluator(labelCol=label, metricName="areaUnderROC")
    dealt = assemble(train.filter(F.col(label).isNotNull()), features).select("features", label, F.rand(seed).alias("_at")).cache()

    def auc(draw: int, fold: int) -> float:
        held = (F.col("_at") >= fold / folds) & (F.col("_at") < (fold + 1) / folds)
        return scorer.evaluate(gbt.fit(dealt.filter(~held), maps[draw]).transform(dealt.filter(held)))

    fits = [inheritable_thread_target(spark)(partial(auc, d, f)) for d in range(draws) for f in range(folds)]
    try:
        with ThreadPoolExecutor(parallelism) as pool:
            scores = list(pool.map(lambda fit: fit(), fits))
        means = [sum(scores[d * folds : (d + 1) * folds]) / folds for d in range(draws)]
        return Searched(gbt.fit(dealt, maps[means.index(max(means))]), means, maps)
    finally:
        dealt.unpersist()


def search_report(spark: SparkSession, fitted: Searched) -> DataFrame:
    """One row per draw: its parameters, its mean AUC, whether it won."""
    rows = []
    best = max(fitted.avgMetrics)
    for i, (params, auc) in enumerate(zip(fitted.getEstimatorParamMaps(), fitted.avgMetrics)):
        named = {p.name: v for p, v in params.items()}
        rows.append((i, int(named["maxDepth"]), float(named["stepSize"]), float(named["subsamplingRate"]), float(auc), bool(auc == best)))
    return spark.createDataFrame(
        rows, "draw int, max_depth int, step_size double, subsampling double, mean_auc double, is_best boolean"
    )


def importance(spark: SparkSession, model, features: Sequence[str]) -> DataFrame:
    """Share of the split gain per feature."""
    values = model.featureImportances.toArray()
    return spark.createDataFrame([(f, float(v)) for f, v in zip(features, values)], "feature string, importance double")


def evaluate_methods(
    splits: Sequence[int], imputers: dict[str, Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame]]],
    rows: DataFrame, features: Sequence[str], label: str, rounds: int = 100,
) -> DataFrame:
    """Per imputation method and split: fit the imputer on train, fill both sides, fit a
    classifier, score the test side. The loop only starts fits; all rows stay in Spark."""
    from lacuna.operators.metrics import binary_scores

    scored = None
    for name, fill in imputers.items():
        for s in splits:
            part = rows.filter(F.col("split_num") == s)
            train, test = fill(part.filter(F.col("role") == "train"), part.filter(F.col("role") == "test"))
            model = fit_classifier(train, features, label, rounds=rounds)
            out = positive_probability(model, test, features).select(
                F.lit(name).alias("name"), F.lit(s).alias("split_num"), F.col(label).alias("label"), "prob"
            )
            scored = out if scored is None else scored.unionByName(out)
    return binary_scores(scored, ("name", "split_num"))
