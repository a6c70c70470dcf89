"""Combining model probabilities: long tables (split_num, sample_id, label, model, prob)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.functions.scan import exact_quantiles
from lacuna.operators.metrics import binary_scores, roc_auc
from lacuna.sources.files import join_stats, stored

SAMPLE = ("split_num", "sample_id", "label")

# Production weights, before division by their sum.
PRODUCTION_WEIGHTS = {"lstm": 0.7357, "gru": 0.7000, "transformer": 0.6556, "xgboost": 0.7077}
PUBLISHED_AUC = {"lstm": 0.7363, "gru": 0.6990, "transformer": 0.6265, "xgboost": 0.7082}


def soft_vote(probs: DataFrame) -> DataFrame:
    """Mean of the probabilities a sample has; a model without any does not count."""
    return probs.groupBy(*SAMPLE).agg(F.avg("prob").alias("prob"))


def weighted(probs: DataFrame, weights: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """Weighted mean. Negative weights count as 0, missing ones as 1; if all of a sample's
    weights are 0 they are equal. One missing probability makes the result missing,
    except that a model with none at all in a split takes no part."""
    live = probs.groupBy("split_num", "model").agg(F.count("prob").alias("_n")).filter("_n > 0").drop("_n")
    w = F.greatest(F.coalesce("weight", F.lit(1.0)), F.lit(0.0)).alias("_w")
    table = live.join(weights, list(by), "left").select("split_num", "model", w)
    joined = join_stats(probs, table, ["split_num", "model"], "inner")
    total = F.sum("_w")
    mean = F.when(total > 0, F.sum(F.col("prob") * F.col("_w")) / total).otherwise(F.avg("prob"))
    return joined.groupBy(*SAMPLE).agg(F.when(F.count("prob") == F.count(F.lit(1)), mean).alias("prob"))


def auc_weights(probs: DataFrame) -> DataFrame:
    """Weight of a model in a split: its AUC there, 0 where that is undefined. The labels
    are those it is scored on later; use validation rows where there are any."""
    return roc_auc(probs, ("split_num", "model")).select("split_num", "model", F.coalesce("auc", F.lit(0.0)).alias("weight"))


def fixed_weights(probs: DataFrame, weights: dict[str, float] = PRODUCTION_WEIGHTS) -> DataFrame:
    """Fixed weights divided by their sum, applied to complete samples."""
    total = sum(weights.values())
    w = F.lit(None).cast("double")
    for name, value in weights.items():
        w = F.when(F.col("model") == name, F.lit(value / total)).otherwise(w)
    use = probs.withColumn("_w", w).filter(F.col("_w").isNotNull())
    return use.groupBy(*SAMPLE).agg(
        F.when(F.count("prob") == len(weights), F.sum(F.col("prob") * F.col("_w"))).alias("prob")
    )


def stacked(probs: DataFrame, models: Sequence[str], splits: Sequence[int]) -> DataFrame:
    """Logistic regression on the model probabilities of all other splits.

    Missing probabilities take the model's median in that split, 0.5 if it has none;
    columns are standardised, classes balanced. Training rows of one class only fall
    back to the soft vote. The loop is over held-out splits, each fit is distributed.
    """
    med = exact_quantiles(probs, ["split_num", "model"], "prob", {"_med": 0.5}, pieces=16)
    filled = join_stats(probs, med, ["split_num", "model"]).withColumn(
        "prob", F.coalesce("prob", "_med", F.lit(0.5))
    )
    wide = filled.groupBy(*SAMPLE).agg(
        *[F.coalesce(F.max(F.when(F.col("model") == m, F.col("prob"))), F.lit(0.5)).alias(m) for m in models]
    )
    # Every fit reads these rows many times: write them once.
    rows = VectorAssembler(inputCols=list(models), outputCol="_raw").transform(stored(probs.sparkSession, wide, "stack"))
    out = None
    counts = {
        r["split_num"]: (r["n"], r["p"])
        for r in rows.groupBy("split_num").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("p")).collect()
    }
    for held in splits:
        n = sum(v[0] for k, v in counts.items() if k != held)
        pos = sum(v[1] for k, v in counts.items() if k != held)
        test = rows.filter(F.col("split_num") == held)
        if n == 0 or pos in (0, n):
            part = soft_vote(probs.filter(F.col("split_num") == held))
        else:
            train = rows.filter(F.col("split_num") != held)
            scaler = StandardScaler(inputCol="_raw", outputCol="_x", withMean=True).fit(train)
            weight = F.when(F.col("label") == 1, F.lit(n / (2.0 * pos))).otherwise(F.lit(n / (2.0 * (n - pos))))
            lr = LogisticRegression(
                featuresCol="_x", labelCol="label", weightCol="_cw", regParam=1.0 / n, standardization=False, maxIter=1000
            )
            model = lr.fit(scaler.transform(train).withColumn("_cw", weight))
            scored = model.transform(scaler.transform(test))
            part = scored.select(*SAMPLE, vector_to_array("probability")[1].alias("prob"))
        out = part if out is None else out.unionByName(part)
    return out


def evaluate(strategies: dict[str, DataFrame], threshold: float = 0.5) -> DataFrame:
    """Scores of every strategy and split, one row each."""
    stacked_rows = None
    for name, df in strategies.items():
        tagged = df.select(*SAMPLE, "prob", F.lit(name).alias("name"))
        stacked_rows = tagged if stacked_rows is None else stacked_rows.unionByName(tagged)
    return binary_scores(stacked_rows, ("name", "split_num"), threshold=threshold)
