"""Summaries and rankings of result tables (one row per method, pattern, split, ...).

These tables have a row per experiment, not per measurement, and every ranking window
runs on aggregated rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacuna.operators.spatial import correlation

# Nominal gap days per pattern, reporting order, the renamed method.
GAP_DAYS = {
    "random_10": 1,
    "random_20": 1,
    "block_7day": 7,
    "block_14day": 14,
    "cross_variable": 30,
    "seasonal": 60,
    "rolling_origin": 90,
    "rolling_origin_180": 180,
}
PATTERN_ORDER = (
    "block_7day", "block_14day", "random_10", "random_20",
    "seasonal", "cross_variable", "rolling_origin", "rolling_origin_180",
)
RENAMED = {"Cross-Location Regression": "Cross-Location Linear Regression"}


def method_name(col: str | Column) -> Column:
    """Arrows become ``->``; one method has two spellings."""
    c = F.replace(F.col(col) if isinstance(col, str) else col, F.lit("→"), F.lit("->"))
    out = c
    for old, new in RENAMED.items():
        out = F.when(F.trim(c) == old, F.lit(new)).otherwise(out)
    return out


def summarise(results: DataFrame, levels: Sequence[Sequence[str]], metrics: Sequence[str] = ("rmse", "mae", "r2")) -> DataFrame:
    """Mean, sample deviation, min and max of each metric at several levels in one pass;
    a column that a level does not group by is NULL."""
    every = sorted({c for level in levels for c in level})
    aggs = [
        f(m).alias(f"{m}_{tag}")
        for m in metrics
        for tag, f in (("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max))
    ]
    sets = [[F.col(c) for c in level] for level in levels]
    return results.groupingSets(sets, *[F.col(c) for c in every]).agg(*aggs)


def category(name: str = "method_name") -> Column:
    """Family of a method by the words in its display name."""
    n = F.lower(F.col(name))
    spatial = ["kriging", "cross-location", "distance", "advection", "eof"]
    hit = reduce(lambda a, b: a | b, [n.contains(w) for w in spatial])
    return F.when(n.contains("hybrid"), F.lit("Hybrid")).when(hit, F.lit("Spatial")).otherwise(F.lit("Temporal"))


def pattern_days(col: str = "mask_type") -> Column:
    table = F.create_map(*[x for k, v in GAP_DAYS.items() for x in (F.lit(k), F.lit(v))])
    return F.try_element_at(table, F.col(col))


def pivot_metric(results: DataFrame, index: str, columns: str, values: Sequence[str], metric: str) -> DataFrame:
    """Mean of a metric, one column per listed value and ``row_mean`` over the cells."""
    cells = results.groupBy(index, columns).agg(F.avg(metric).alias("_m"))
    picked = [F.max(F.when(F.col(columns) == v, F.col("_m"))).alias(v) for v in values]
    return cells.groupBy(index).agg(*picked, F.avg("_m").alias("row_mean"))


def rank_methods(results: DataFrame, by: str, metric: str) -> DataFrame:
    means = results.groupBy(by).agg(F.avg(metric).alias(f"{metric}_mean"))
    w = Window.orderBy(F.col(f"{metric}_mean").asc_nulls_last(), by)
    return means.withColumn("rank", F.row_number().over(w))


def best_per_pattern(summary: DataFrame) -> DataFrame:
    """Lowest RMSE per pattern; a pattern without any keeps a row of NULLs."""
    w = Window.partitionBy("mask_type").orderBy(F.col("rmse").asc_nulls_last(), "method_name")
    order = F.array_position(F.array(*[F.lit(p) for p in PATTERN_ORDER]), F.col("mask_type"))
    best = summary.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") == 1)
    known = F.col("rmse").isNotNull()
    keep = [F.when(known, F.col(c)).alias(c) for c in ("method_name", "rmse", "mae", "r2")]
    return best.select("mask_type", *keep, F.when(order > 0, order).otherwise(F.lit(999)).cast("long").alias("pattern_order"))


def master_comparison(meta: DataFrame, sources: Sequence[DataFrame], downstream: DataFrame) -> DataFrame:
    """Method catalogue with imputation scores (the first source wins) and downstream
    scores; rank by AUC, equal scores sharing the lower rank, unscored methods unranked."""
    tagged = [s.withColumn("_src", F.lit(i)).withColumn("method_name", method_name("method_name")) for i, s in enumerate(sources)]
    stacked = reduce(lambda a, b: a.unionByName(b), tagged)
    cols = [c for c in stacked.columns if c not in ("method_name", "_src")]
    first = stacked.groupBy("method_name").agg(F.min_by(F.struct(*cols), "_src").alias("s")).select(
        "method_name", *[F.col(f"s.{c}").alias(c) for c in cols]
    )
    down = downstream.withColumn("method_name", method_name("method_name"))
    joined = meta.join(first, "method_name", "left").join(down, "method_name", "left")
    w = Window.orderBy(F.desc_nulls_last("auc"))
    return joined.withColumn("auc_rank", F.when(F.col("auc").isNotNull(), F.rank().over(w)))


def missing_metric_report(master: DataFrame) -> DataFrame:
    """A message per method and missing family of metrics, in one pass over the catalogue."""
    def note(col: str, text: str) -> Column:
        message = F.concat(F.lit(text), F.lit(" for method: "), F.col("method_name")).alias("message")
        return F.when(F.col(col).isNull(), F.struct("method_name", message))
    notes = F.array(note("rmse", "Missing imputation metrics"), note("auc", "Missing downstream metrics"))
    return master.select(F.inline(F.filter(notes, lambda n: n.isNotNull())))


def per_split_note(results: DataFrame, split: int = 3) -> DataFrame:
    text = f"Split {split} AUC may be uninformative (very low/zero bloom-event prevalence)."
    note = F.when(F.col("split_num") == split, F.lit(text)).otherwise(F.lit(""))
    return results.select(method_name("method_name").alias("method_name"), "split_num", "auc", note.alias("note"))


def split_summary(results: DataFrame, by: str, metrics: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Mean and deviation over splits, the number of splits, and the rank by ``order``."""
    aggs = [f(m).alias(f"{m}_{t}") for m in metrics for t, f in (("mean", F.avg), ("std", F.stddev_samp))]
    base = results.groupBy(by).agg(*aggs, F.count_distinct("split_num").alias("n_splits"))
    return base.withColumn("rank", F.row_number().over(Window.orderBy(*order, by)))


def pairwise_delta(summary: DataFrame, by: str, metrics: Sequence[str], a: str, b: str) -> DataFrame:
    """Metric by metric: value of ``a``, value of ``b``, and a - b."""
    long = summary.filter(F.col(by).isin(a, b)).unpivot([by], list(metrics), "metric", "v")
    at = lambda x: F.max(F.when(F.col(by) == x, F.col("v")))
    return long.groupBy("metric").agg(at(a).alias("value_a"), at(b).alias("value_b"), (at(a) - at(b)).alias("delta"))


def model_comparison(models: DataFrame, ensembles: DataFrame, prefer: str, order: Sequence[str] = ("auc", "f1", "recall")) -> DataFrame:
    """Single models plus the best ensemble strategy, ranked. Of a model's scenarios the
    preferred one counts, else its best by AUC."""
    desc = [F.col(c).desc_nulls_last() for c in order]
    pref = (F.col("scenario") != prefer).cast("int")
    w = Window.partitionBy("model").orderBy(pref, F.col("auc").desc_nulls_last(), "scenario")
    single = models.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") == 1).drop("_r")
    top = ensembles.orderBy(*desc, "model").limit(1)
    both = single.unionByName(top)
    return both.withColumn("rank", F.row_number().over(Window.orderBy(*desc, "model")))


def topk_importance(importance: DataFrame, by: Sequence[str], k: int = 15) -> DataFrame:
    """Mean importance over splits, the ``k`` largest per group."""
    mean = importance.groupBy(*by, "feature").agg(F.avg("importance").alias("importance"))
    w = Window.partitionBy(*by).orderBy(F.desc("importance"), "feature")
    return mean.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def pair_fit(pairs: DataFrame, value: str = "value", donor: str = "donor_value") -> DataFrame:
    """Correlation and straight-line fit of each site pair and variable."""
    both = pairs.filter(F.col(value).isNotNull() & F.col(donor).isNotNull())
    return both.groupBy("location", "donor", "variable").agg(
        F.count(F.lit(1)).alias("n"), correlation(value, donor).alias("r"),
        F.regr_slope(donor, value).alias("slope"), F.regr_intercept(donor, value).alias("intercept"),
    )
