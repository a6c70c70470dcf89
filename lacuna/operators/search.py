"""Parameter search over splits, draws and folds with a ledger that a broken run goes on from.

Every fit is one entry of the ledger, a small file of its own in the shared folder: which split, draw and
fold it was, its parameters and its score. A run only starts the fits the ledger lacks, a few at a time;
each of them is a Spark job over its rows. The ledger then says which parameters won in every
split, with which the split's model is fitted and scored, and whose parameters the final model takes.
"""

from __future__ import annotations

import json
import random
import uuid
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.operators.models import assemble, positive_probability

# The search space, by the names of the study.
SPACE = {
    "learning_rate": (0.01, 0.05, 0.1, 0.2),
    "max_depth": (3, 4, 5, 6, 7, 8),
    "n_estimators": (50, 100, 200, 300, 500),
    "subsample": (0.6, 0.7, 0.8, 0.9, 1.0),
    "colsample_bytree": (0.6, 0.7, 0.8, 0.9, 1.0),
    "scale_pos_weight": (1, 5, 10, 20, 50, 100),
    "min_child_weight": (1, 3, 5, 7),
    "gamma": (0, 0.1, 0.2, 0.3, 0.4),
}
DRAWS, FOLDS = 20, 3
ENTRY = "split_num int, draw int, fold int, params string, auc double"


def draw_params(draws: int = DRAWS, seed: int = 42, space: dict[str, Sequence] = SPACE) -> list[dict]:
    """Random points of the space, no two alike as long as there are others."""
    rng = random.Random(seed)
    size = 1
    for values in space.values():
        size *= len(values)
    out: list[dict] = []
    while len(out) < min(draws, size):
        one = {k: rng.choice(v) for k, v in space.items()}
        if one not in out:
            out.append(one)
    return out


def classifier(params: dict, label: str, seed: int = 42) -> GBTClassifier:
    """Boosted trees with the study's parameters: leaf weight is rows, gamma the gain a split must bring; positives weigh by a column."""
    return GBTClassifier(
        featuresCol="features", labelCol=label, weightCol="_weight", seed=seed, stepSize=params["learning_rate"], maxDepth=params["max_depth"], maxIter=params["n_estimators"],
        subsamplingRate=params["subsample"], featureSubsetStrategy=str(params["colsample_bytree"]), minInstancesPerNode=params["min_child_weight"], minInfoGain=float(params["gamma"]),
    )


def fit(rows: DataFrame, features: Sequence[str], label: str, params: dict, seed: int = 42) -> GBTClassificationModel:
    weighed = rows.withColumn("_weight", F.when(F.col(label) == 1, F.lit(float(params["scale_pos_weight"]))).otherwise(F.lit(1.0)))
    return classifier(params, label, seed).fit(assemble(weighed, features))


class Ledger:
    """The fits made so far: a folder each, so that fits that end together do not meet."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        spark.createDataFrame([], ENTRY).write.mode("overwrite").json(f"{path}/empty")

    def entries(self) -> DataFrame:
        """One row per fit; a fit that was made twice, by two runs, counts once."""
        return self.spark.read.schema(ENTRY).json(f"{self.path}/*").dropDuplicates(["split_num", "draw", "fold", "params"])

    def add(self, split: int, draw: int, fold: int, params: dict, auc: float) -> None:
        row = (split, draw, fold, json.dumps(params, sort_keys=True), auc)
        self.spark.createDataFrame([row], ENTRY).coalesce(1).write.json(f"{self.path}/{uuid.uuid4().hex}")


def search(
    train: DataFrame, features: Sequence[str], label: str, ledger: Ledger, splits: Sequence[int], draws: Sequence[dict], folds: int = FOLDS,
    row_key: Sequence[str] = ("location", "obs_date"), parallelism: int = 4, seed: int = 42,
) -> int:
    """Fit and score by AUC whatever the ledger lacks of every split, draw and fold; how many fits that were.

    ``train`` has split_num. Folds follow a hash of the row, so that a later run cuts the
    same ones. A fold in which only one class is left scores 0.5.
    """
    made = {(r.split_num, r.draw, r.fold, r.params) for r in ledger.entries().select("split_num", "draw", "fold", "params").collect()}
    todo = [(s, d, f) for s in splits for d in range(len(draws)) for f in range(folds) if (s, d, f, json.dumps(draws[d], sort_keys=True)) not in made]
    rows = train.withColumn("_fold", F.pmod(F.xxhash64(*row_key), F.lit(folds)).cast("int"))
    scorer = BinaryClassificationEvaluator(labelCol=label, rawPredictionCol="rawPrediction", metricName="areaUnderROC")

    def one(split: int, draw: int, fold: int) -> None:
        own = rows.filter(F.col("split_num") == split)
        learn, rest = own.filter(F.col("_fold") != fold), own.filter(F.col("_fold") == fold)
        classes = [side.select(F.countDistinct(label)).first()[0] for side in (learn, rest)]
        auc = 0.5
        if min(classes) > 1:
            auc = scorer.evaluate(fit(learn, features, label, draws[draw], seed).transform(assemble(rest, features)))
        ledger.add(split, draw, fold, draws[draw], float(auc))

    with ThreadPoolExecutor(parallelism) as pool:
        list(pool.map(lambda t: one(*t), todo))
    return len(todo)


def winners(ledger: Ledger) -> DataFrame:
    """(split_num, draw, params, mean_auc) of the draw with the best mean over its folds in every split; of equals the first."""
    mean = ledger.entries().groupBy("split_num", "draw", "params").agg(F.avg("auc").alias("mean_auc"))
    return mean.groupBy("split_num").agg(F.max_by(F.struct("draw", "params", "mean_auc"), F.struct("mean_auc", -F.col("draw"))).alias("w")).select("split_num", "w.*")


def report(ledger: Ledger) -> DataFrame:
    """One row per split and draw: folds, mean AUC, whether it won."""
    best = winners(ledger).select("split_num", F.col("draw").alias("_won"))
    mean = ledger.entries().groupBy("split_num", "draw").agg(F.count(F.lit(1)).alias("folds"), F.avg("auc").alias("mean_auc"))
    return mean.join(best, "split_num").withColumn("is_best", F.col("draw") == F.col("_won")).drop("_won")


def scored_splits(rows: DataFrame, features: Sequence[str], label: str, ledger: Ledger, seed: int = 42) -> DataFrame:
    """(split_num, label, prob) of every split's test rows by the model with its winning parameters, fitted on all its training rows."""
    out = None
    for w in winners(ledger).orderBy("split_num").collect():
        own = rows.filter(F.col("split_num") == w.split_num)
        model = fit(own.filter(F.col("role") == "train"), features, label, json.loads(w.params), seed)
        one = positive_probability(model, own.filter(F.col("role") == "test"), features).select("split_num", F.col(label).alias("label"), "prob")
        out = one if out is None else out.unionByName(one)
    return out


def refit(rows: DataFrame, features: Sequence[str], label: str, ledger: Ledger, scores: DataFrame, seed: int = 42) -> tuple[GBTClassificationModel, dict]:
    """The final model on all ``rows`` with the parameters of the split whose test AUC is best, and these.

    ``scores`` has split_num and auc; a split without an AUC cannot win.
    """
    best = scores.filter(F.col("auc").isNotNull()).orderBy(F.desc("auc"), "split_num").select("split_num").first()
    params = json.loads(winners(ledger).filter(F.col("split_num") == best.split_num).first().params)
    return fit(rows, features, label, params, seed), params


def top_importance(spark: SparkSession, model, features: Sequence[str], top: int = 15) -> DataFrame:
    """The features with the largest share of the split gain, at most ``top``; ties by name."""
    values = sorted(zip(model.featureImportances.toArray().tolist(), features, strict=True), key=lambda v: (-v[0], v[1]))[:top]
    return spark.createDataFrame([(k, f, float(v)) for k, (v, f) in enumerate(values, 1)], "rank int, feature string, importance double")
