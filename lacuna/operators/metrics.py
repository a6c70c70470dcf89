"""Scoring fills and classifiers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.functions.scan import exact_quantiles, running_totals


def fill_scores(df: DataFrame, by: Sequence[str], truth: str = "truth", filled: str = "filled") -> DataFrame:
    """RMSE, MAE, R2 over cells where both exist, with the number masked and the coverage.

    R2 is 1 - SSE/SST with a centred SST; NULL where the truth does not vary. Coverage
    stands beside the errors because a method may look good on the few cells it fills.
    """
    both = F.col(truth).isNotNull() & F.col(filled).isNotNull()
    err = F.when(both, F.col(truth) - F.col(filled))
    y = F.when(both, F.col(truth))
    sst = F.var_pop(y) * F.count(y)
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("missing_count"),
        F.count(err).alias("filled_count"),
        (F.count(err) / F.count(F.lit(1))).alias("coverage"),
        F.sqrt(F.avg(err * err)).alias("rmse"),
        F.avg(F.abs(err)).alias("mae"),
        (F.lit(1.0) - F.try_divide(F.sum(err * err), sst)).alias("r2"),
    )


def confusion(df: DataFrame, by: Sequence[str], label: str = "label", pred: str = "pred") -> DataFrame:
    hit = lambda a, b: F.sum(((F.col(label) == a) & (F.col(pred) == b)).cast("long"))
    return df.groupBy(*by).agg(
        hit(1, 1).alias("tp"), hit(0, 1).alias("fp"), hit(1, 0).alias("fn"), hit(0, 0).alias("tn")
    )


def f1_of(tp: Column, fp: Column, fn: Column) -> Column:
    """2TP / (2TP + FP + FN), 0 where it is undefined."""
    return F.coalesce(F.try_divide(tp * 2, tp * 2 + fp + fn), F.lit(0.0)).cast("double")


def with_f1(conf: DataFrame) -> DataFrame:
    """Macro F1 and support-weighted F1 from confusion counts."""
    pos = f1_of(F.col("tp"), F.col("fp"), F.col("fn"))
    neg = f1_of(F.col("tn"), F.col("fn"), F.col("fp"))
    p, n = F.col("tp") + F.col("fn"), F.col("tn") + F.col("fp")
    return conf.withColumn("macro_f1", (pos + neg) / 2).withColumn("weighted_f1", (pos * p + neg * n) / (p + n))


def _score_counts(df: DataFrame, by: Sequence[str], label: str, prob: str) -> DataFrame:
    """Positives and negatives per distinct score: the only thing AUC and threshold
    search need, and far smaller than the rows."""
    return df.filter(F.col(prob).isNotNull() & F.col(label).isNotNull()).groupBy(*by, prob).agg(
        F.sum((F.col(label) == 1).cast("long")).alias("pos"), F.sum((F.col(label) != 1).cast("long")).alias("neg")
    )


def roc_auc(df: DataFrame, by: Sequence[str], label: str = "label", prob: str = "prob") -> DataFrame:
    """Area under the ROC curve per group, ties counting half; NULL with one class."""
    run = running_totals(_score_counts(df, by, label, prob), by, prob, ["pos", "neg"])
    wins = F.col("pos") * (F.col("neg_upto") - F.col("neg") / F.lit(2.0))
    return run.groupBy(*by).agg(
        F.try_divide(F.sum(wins), F.max("pos_all") * F.max("neg_all").cast("double")).alias("auc")
    )


def binary_scores(
    df: DataFrame, by: Sequence[str], label: str = "label", prob: str = "prob", threshold: float = 0.5
) -> DataFrame:
    """Accuracy, precision, recall, F1, AUC at a threshold.

    A missing probability counts as 0.5; a group without any probability has NULL for
    every score.
    """
    p = F.coalesce(F.col(prob), F.lit(0.5))
    clean = df.select(*by, label, p.alias("_p"), (p >= threshold).cast("int").alias("_pred"), F.col(prob).alias("_raw"))
    one = F.col(label) == 1
    said = F.col("_pred") == 1
    total = lambda c: F.sum(c.cast("long"))
    counts = clean.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count("_raw").alias("_any"),
        total(one & said).alias("_tp"), total(~one & said).alias("_fp"),
        total(one & ~said).alias("_fn"), total(~one & ~said).alias("_tn"),
    )
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp, fp, fn, tn = (F.col(c) for c in ("_tp", "_fp", "_fn", "_tn"))
    known = F.col("_any") > 0
    auc = roc_auc(clean, by, label, "_p")
    scores = counts.join(auc, list(by), "left")
    return scores.select(
        *by, "n",
        F.when(known, (tp + tn) / F.col("n")).alias("accuracy"),
        F.when(known, ratio(tp, tp + fp)).alias("precision"),
        F.when(known, ratio(tp, tp + fn)).alias("recall"),
        F.when(known, f1_of(tp, fp, fn)).alias("f1"),
        F.when(known, F.col("auc")).alias("auc"),
    )


def best_threshold(
    df: DataFrame, by: Sequence[str], label: str = "label", prob: str = "prob", clip: tuple[float, float] = (0.1, 0.5)
) -> DataFrame:
    """Threshold with the highest macro F1 among the distinct scores, clipped; the larger
    one on a tie, and 0.5 where a group has one class only."""
    run = running_totals(_score_counts(df, by, label, prob), by, prob, ["pos", "neg"])
    tp = F.col("pos_all") - F.col("pos_upto") + F.col("pos")
    fp = F.col("neg_all") - F.col("neg_upto") + F.col("neg")
    fn, tn = F.col("pos_all") - tp, F.col("neg_all") - fp
    macro = (f1_of(tp, fp, fn) + f1_of(tn, fn, fp)) / 2
    scored = run.withColumn("_f1", macro)
    both = (F.max("pos_all") > 0) & (F.max("neg_all") > 0)
    best = F.max_by(prob, F.struct("_f1", prob))
    clipped = F.least(F.greatest(best, F.lit(clip[0])), F.lit(clip[1]))
    return scored.groupBy(*by).agg(
        F.when(both, clipped).otherwise(F.lit(0.5)).alias("threshold"), F.when(both, F.max("_f1")).alias("macro_f1")
    )


def regression_event_scores(
    df: DataFrame, by: Sequence[str], truth: str, predicted: str, threshold: float = 1.0
) -> DataFrame:
    """Error measures of a regression plus F1 and AUC of "value >= threshold"."""
    errors = fill_scores(df, by, truth, predicted).drop("missing_count", "coverage", "filled_count")
    events = df.filter(F.col(truth).isNotNull() & F.col(predicted).isNotNull()).select(
        *by, (F.col(truth) >= threshold).cast("int").alias("label"),
        (F.col(predicted) >= threshold).cast("int").alias("pred"), F.col(predicted).alias("prob"),
    )
    f1 = confusion(events, by).select(*by, f1_of(F.col("tp"), F.col("fp"), F.col("fn")).alias("f1"))
    auc = roc_auc(events, by)
    return errors.join(f1, list(by), "left").join(auc, list(by), "left")


def error_distribution(
    df: DataFrame, by: Sequence[str], value: str, bins: int = 10, lo: float = 0.0, hi: float = 1.0
) -> DataFrame:
    """Mean, quartiles and a fixed-width histogram (as an array of counts) per group."""
    bucket = F.least(F.greatest(F.floor((F.col(value) - lo) / ((hi - lo) / bins)), F.lit(0)), F.lit(bins - 1))
    known = df.filter(F.col(value).isNotNull()).withColumn("_b", bucket)
    hist = [F.sum((F.col("_b") == i).cast("long")).alias(f"bin_{i}") for i in range(bins)]
    basics = known.groupBy(*by).agg(F.avg(value).alias("mean"), *hist)
    quartiles = exact_quantiles(known, by, value, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    return basics.join(quartiles, list(by))


def class_weights(df: DataFrame, by: Sequence[str], label: str = "label") -> DataFrame:
    """n / (2 n_c) for both classes, and negatives per positive."""
    pos = F.sum((F.col(label) == 1).cast("long"))
    neg = F.sum((F.col(label) == 0).cast("long"))
    n = pos + neg
    return df.filter(F.col(label).isNotNull()).groupBy(*by).agg(
        F.try_divide(n, neg * 2).alias("weight_0"),
        F.try_divide(n, pos * 2).alias("weight_1"),
        (neg / F.greatest(pos, F.lit(1))).alias("pos_weight"),
    )
