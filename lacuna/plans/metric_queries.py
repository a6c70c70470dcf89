"""Registered queries: scores, summaries, rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.operators import hybrid, metrics, reports
from lacuna.operators.panel import with_donor
from lacuna.plans import study
from lacuna.plans.common import R, cells, cells_sql, donors_sql, labels_sql, pairs_sql, r, rr, with_
from lacuna.plans.study import FILLS, RESULTS, scores_sql
from lacuna.sources import tables as T

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn
    return add


def rounded_sql(*cols: str, digits: int = 4) -> str:
    return ", ".join(f"{R(c, digits)} AS {c}" for c in cols)


SCORES = ("coverage", "rmse", "mae", "r2")


@query(with_(*FILLS, scores_sql("method, variable")) + f"SELECT method, variable, missing_count, filled_count, {rounded_sql(*SCORES)} FROM results")
def impute_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return rr(metrics.fill_scores(study.fills(spark, sf), ["method", "variable"]), *SCORES)


@query(with_(*RESULTS) + f"""SELECT mask_type, CAST(split_num AS INTEGER) AS split_num, method, method_name, variable, location, missing_count, filled_count, {rounded_sql(*SCORES)} FROM results""")
def method_results(spark: SparkSession, sf: str) -> DataFrame:
    return rr(study.results(spark, sf), *SCORES)


SUMMARY_COLS = [f"{m}_{t}" for m in ("rmse", "mae", "r2") for t in ("mean", "std", "min", "max")]


@query(with_(*RESULTS, "s AS (SELECT method, mask_type, " + ", ".join(
    f"{f}({m}) AS {m}_{t}" for m in ("rmse", "mae", "r2") for t, f in (("mean", "avg"), ("std", "stddev_samp"), ("min", "min"), ("max", "max"))
) + " FROM results GROUP BY GROUPING SETS ((method), (method, mask_type)))") + f"SELECT method, mask_type, {rounded_sql(*SUMMARY_COLS)} FROM s")
def method_summary(spark: SparkSession, sf: str) -> DataFrame:
    s = reports.summarise(study.results(spark, sf), [("method",), ("method", "mask_type")])
    return rr(s, *SUMMARY_COLS).select("method", "mask_type", *SUMMARY_COLS)


CATEGORY = """CASE WHEN lower(method_name) LIKE '%hybrid%' THEN 'Hybrid' WHEN regexp_matches(lower(method_name), 'kriging|cross-location|distance|advection|eof') THEN 'Spatial' ELSE 'Temporal' END"""


@query(with_(*RESULTS) + f"SELECT {CATEGORY} AS category, count(*) AS n, {R('avg(rmse)')} AS rmse, {R('avg(mae)')} AS mae, {R('avg(r2)')} AS r2 FROM results GROUP BY 1")
def category_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return study.results(spark, sf).groupBy(reports.category().alias("category")).agg(
        F.count(F.lit(1)).alias("n"), *[r(F.avg(m)).alias(m) for m in ("rmse", "mae", "r2")]
    )


GAPPED = "gapped AS (SELECT *, CAST(CASE mask_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in reports.GAP_DAYS.items()) + " END AS INTEGER) AS gap_days FROM results)"
BY_METHOD = [R(f"max(CASE WHEN method = '{m}' THEN m END)") + f" AS {m}" for m in study.STUDY_METHODS]


@query(with_(*RESULTS, GAPPED, "means AS (SELECT gap_days, method, avg(rmse) AS m FROM gapped GROUP BY 1, 2)") + f"SELECT gap_days, {', '.join(BY_METHOD)}, {R('avg(m)')} AS row_mean FROM means GROUP BY gap_days")
def decay_by_gap(spark: SparkSession, sf: str) -> DataFrame:
    rows = study.results(spark, sf).withColumn("gap_days", reports.pattern_days())
    out = reports.pivot_metric(rows, "gap_days", "method", study.STUDY_METHODS, "rmse")
    return rr(out, *study.STUDY_METHODS, "row_mean")


PIVOT = ", ".join(f"max(CASE WHEN mask_type = '{p}' THEN v END) AS {p}" for p in study.PATTERNS)


@query(with_(*RESULTS, "g AS (SELECT method, mask_type, least(greatest(avg(r2), -1.5), 1.0) AS v FROM results GROUP BY 1, 2)",
f"p AS (SELECT method, {PIVOT}, avg(v) AS row_mean FROM g GROUP BY 1)")
+ f"SELECT method, {rounded_sql(*study.PATTERNS, 'row_mean')}, CAST(row_number() OVER (ORDER BY row_mean DESC, method) AS INTEGER) AS position FROM p")
def method_pattern_pivot(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    means = study.results(spark, sf).groupBy("method", "mask_type").agg(
        F.least(F.greatest(F.avg("r2"), F.lit(-1.5)), F.lit(1.0)).alias("r2")
    )
    out = reports.pivot_metric(means, "method", "mask_type", study.PATTERNS, "r2")
    out = out.withColumn("position", F.row_number().over(Window.orderBy(F.desc("row_mean"), "method")))
    return rr(out, *study.PATTERNS, "row_mean")


@query(with_(*RESULTS) + f"SELECT method, {R('m')} AS rmse_mean, CAST(row_number() OVER (ORDER BY m, method) AS INTEGER) AS rank FROM (SELECT method, avg(rmse) AS m FROM results GROUP BY 1)")
def method_rank(spark: SparkSession, sf: str) -> DataFrame:
    return rr(reports.rank_methods(study.results(spark, sf), "method", "rmse"), "rmse_mean")


ORDER = "CASE mask_type " + " ".join(f"WHEN '{p}' THEN {i + 1}" for i, p in enumerate(reports.PATTERN_ORDER)) + " ELSE 999 END"


@query(with_(*RESULTS, "g AS (SELECT mask_type, method_name, avg(rmse) AS rmse, avg(mae) AS mae, avg(r2) AS r2 FROM results GROUP BY 1, 2)")
+ f"SELECT mask_type, method_name, {rounded_sql('rmse', 'mae', 'r2')}, CAST({ORDER} AS BIGINT) AS pattern_order FROM g QUALIFY row_number() OVER (PARTITION BY mask_type ORDER BY rmse NULLS LAST, method_name) = 1")
def best_method_per_pattern(spark: SparkSession, sf: str) -> DataFrame:
    means = study.results(spark, sf).groupBy("mask_type", "method_name").agg(*[F.avg(m).alias(m) for m in ("rmse", "mae", "r2")])
    return rr(reports.best_per_pattern(means), "rmse", "mae", "r2")


# Downstream scores of a method: its fills as a forecast of "balance is at least 4500".
EVENT = 4500.0
AUC_SQL = """(SELECT {by}, sum(CASE WHEN label = 1 THEN rk ELSE 0 END) AS rs, CAST(sum(label) AS DOUBLE) AS p, CAST(sum(1 - label) AS DOUBLE) AS n FROM (
    SELECT *, rank() OVER (PARTITION BY {by} ORDER BY prob) + (count(*) OVER (PARTITION BY {by}, prob) - 1) / 2.0::DOUBLE AS rk FROM {src}) GROUP BY {by})"""


def auc_sql(by: str, src: str, name: str = "auc") -> str:
    return f"{name} AS (SELECT {by}, (rs - p * (p + 1) / 2) / nullif(p * n, 0) AS auc FROM {AUC_SQL.format(by=by, src=src)})"


EVENTS = [
    *FILLS, "bal AS (SELECT method, truth, round(filled + 1e-8, 4) AS filled FROM fills WHERE variable = 'balance' AND filled IS NOT NULL)",
    f"ev AS (SELECT method, CASE WHEN truth >= {EVENT} THEN 1 ELSE 0 END AS label, CASE WHEN filled >= {EVENT} THEN 1 ELSE 0 END AS pred, filled AS prob FROM bal)",
    scores_sql("method", "bal", "err"), auc_sql("method", "ev"),
    """f1 AS (SELECT method, coalesce(2.0::DOUBLE * sum(label * pred) / nullif(sum(label) + sum(pred), 0), 0) AS f1 FROM ev GROUP BY 1)""",
    "down AS (SELECT err.method, rmse, mae, r2, f1, auc FROM err JOIN f1 USING (method) LEFT JOIN auc USING (method))",
]


def _downstream(spark: SparkSession, sf: str) -> DataFrame:
    bal = study.fills(spark, sf).filter((F.col("variable") == "balance") & F.col("filled").isNotNull()).select(
        "method", "truth", r("filled").alias("filled")
    )
    return metrics.regression_event_scores(bal, ["method"], "truth", "filled", EVENT)


@query(with_(*EVENTS) + f"SELECT method, {rounded_sql('rmse', 'mae', 'r2', 'f1', 'auc')} FROM down")
def regression_bloom_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return rr(_downstream(spark, sf), "rmse", "mae", "r2", "f1", "auc")


META = "meta(method, method_name, family) AS (VALUES " + ", ".join(f"('{k}', '{v[0]}', '{v[1]}')" for k, v in hybrid.METHODS.items()) + ")"
MASTER = [
    *EVENTS, META,
    scores_sql("method", name="imp"),
    """master AS (SELECT m.method_name, m.family, imp.rmse, imp.mae, imp.r2, d.auc, d.f1, CASE WHEN d.auc IS NOT NULL THEN rank() OVER (ORDER BY d.auc DESC NULLS LAST) END AS auc_rank
  FROM meta m LEFT JOIN imp ON imp.method = m.method AND imp.method <> 'climatology' LEFT JOIN down d ON d.method = m.method AND d.method <> 'kriging')""",
]


def _master(spark: SparkSession, sf: str) -> DataFrame:
    """Two sources of imputation scores (the first lacks climatology), downstream scores
    without kriging: so that both kinds of missing entry occur."""
    rows = [(k, v[0], v[1]) for k, v in hybrid.METHODS.items()]
    meta = spark.createDataFrame(rows, "method string, method_name string, family string")
    named = meta.select("method", "method_name")
    scored = metrics.fill_scores(study.fills(spark, sf), ["method"]).join(named, "method").select("method", "method_name", "rmse", "mae", "r2")
    first = scored.filter(F.col("method").isin("linear", "hybrid_ensemble")).drop("method")
    second = scored.filter(F.col("method") != "climatology").drop("method")
    down = _downstream(spark, sf).filter(F.col("method") != "kriging").join(named, "method").select("method_name", "auc", "f1")
    return reports.master_comparison(meta.drop("method"), [first, second], down)


@query(with_(*MASTER) + f"SELECT method_name, family, {rounded_sql('rmse', 'mae', 'r2', 'auc', 'f1')}, CAST(auc_rank AS INTEGER) AS auc_rank FROM master")
def master_comparison(spark: SparkSession, sf: str) -> DataFrame:
    return rr(_master(spark, sf), "rmse", "mae", "r2", "auc", "f1")


@query(with_(*MASTER) + """SELECT method_name, 'Missing imputation metrics for method: ' || method_name AS message FROM master WHERE rmse IS NULL
UNION ALL SELECT method_name, 'Missing downstream metrics for method: ' || method_name FROM master WHERE auc IS NULL""")
def missing_metric_report(spark: SparkSession, sf: str) -> DataFrame:
    return reports.missing_metric_report(_master(spark, sf))


# --- classifiers ---------------------------------------------------------------

SCORED = [
    """wide AS (SELECT l.doc_id AS sample_id, CAST(l.doc_id % 6 AS INTEGER) AS split_num, l.quality AS label,
    ((n_chars + l.doc_id * 7) % 1000) / 1000.0::DOUBLE * 0.6::DOUBLE + quality * 0.3::DOUBLE AS lstm,
    CASE WHEN l.doc_id % 9 <> 0 THEN ((n_chars * 3 + l.doc_id * 11) % 997) / 997.0::DOUBLE END AS gru,
    CASE WHEN l.doc_id % 6 <> 5 THEN ((n_chars + l.doc_id) % 500) / 500.0::DOUBLE * 0.5::DOUBLE + toxic * 0.4::DOUBLE END AS transformer,
    ((n_chars * 13 + l.doc_id) % 101) / 101.0::DOUBLE AS xgboost FROM labels l JOIN documents d ON d.doc_id = l.doc_id)""",
    "probs AS (" + " UNION ALL ".join(f"SELECT sample_id, split_num, label, '{m}' AS model, {m} AS prob FROM wide" for m in ("lstm", "gru", "transformer", "xgboost")) + ")",
]


def binary_sql(by: str, src: str, name: str = "bin") -> list[str]:
    return [
        f"{name}_c AS (SELECT {by}, label, coalesce(prob, 0.5) AS prob, CASE WHEN coalesce(prob, 0.5) >= 0.5 THEN 1 ELSE 0 END AS pred, prob AS raw FROM {src})",
        auc_sql(by, f"{name}_c", f"{name}_auc"),
        f"""{name}_n AS (SELECT {by}, count(*) AS n, count(raw) AS k, CAST(sum(label * pred) AS DOUBLE) AS tp, CAST(sum((1 - label) * pred) AS DOUBLE) AS fp,
    CAST(sum(label * (1 - pred)) AS DOUBLE) AS fn, CAST(sum((1 - label) * (1 - pred)) AS DOUBLE) AS tn FROM {name}_c GROUP BY {by})""",
        f"""{name} AS (SELECT {by}, n, CASE WHEN k > 0 THEN (tp + tn) / n END AS accuracy, CASE WHEN k > 0 THEN coalesce(tp / nullif(tp + fp, 0), 0) END AS precision,
    CASE WHEN k > 0 THEN coalesce(tp / nullif(tp + fn, 0), 0) END AS recall, CASE WHEN k > 0 THEN coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) END AS f1,
    CASE WHEN k > 0 THEN auc END AS auc FROM {name}_n LEFT JOIN {name}_auc USING ({by}))""",
    ]


BINARY = ("accuracy", "precision", "recall", "f1", "auc")
MODEL_SPLIT = [*SCORED, *binary_sql("model, split_num", "probs")]


@query(with_(*MODEL_SPLIT) + f"SELECT model, split_num, n, {rounded_sql(*BINARY)} FROM bin")
def binary_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return rr(metrics.binary_scores(T.scores(spark, sf), ("model", "split_num")), *BINARY)


@query(with_(*SCORED, "known AS (SELECT * FROM probs WHERE prob IS NOT NULL)", auc_sql("model", "known")) + f"SELECT model, {R('auc', 6)} AS auc FROM auc")
def roc_auc(spark: SparkSession, sf: str) -> DataFrame:
    return rr(metrics.roc_auc(T.scores(spark, sf), ["model"]), "auc", digits=6)


@query(with_(
    *SCORED, """cut AS (SELECT model, prob AS t, sum(sum(label)) OVER w AS tp, sum(sum(1 - label)) OVER w AS fp,
    sum(sum(label)) OVER (PARTITION BY model) AS p, sum(sum(1 - label)) OVER (PARTITION BY model) AS n
  FROM probs WHERE prob IS NOT NULL GROUP BY model, prob WINDOW w AS (PARTITION BY model ORDER BY prob DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))""",
    """f AS (SELECT model, t, (CAST(2 * tp AS DOUBLE) / (2 * tp + fp + (p - tp)) + coalesce(CAST(2 * (n - fp) AS DOUBLE) / nullif(2 * (n - fp) + fp + (p - tp), 0), 0)) / 2 AS m FROM cut)""",
    "b AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY model ORDER BY m DESC, t DESC) = 1)",
) + f"SELECT model, {R('least(greatest(t, 0.1), 0.5)', 6)} AS threshold, {R('m', 6)} AS macro_f1 FROM b")
def threshold_macro_f1(spark: SparkSession, sf: str) -> DataFrame:
    return rr(metrics.best_threshold(T.scores(spark, sf), ["model"]), "threshold", "macro_f1", digits=6)


@query(with_(*SCORED, "c AS (SELECT model, label, CASE WHEN coalesce(prob, 0.5) >= 0.5 THEN 1 ELSE 0 END AS pred FROM probs)",
"""k AS (SELECT model, CAST(sum(label * pred) AS BIGINT) AS tp, CAST(sum((1 - label) * pred) AS BIGINT) AS fp, CAST(sum(label * (1 - pred)) AS BIGINT) AS fn,
  CAST(sum((1 - label) * (1 - pred)) AS BIGINT) AS tn FROM c GROUP BY 1)""",
"g AS (SELECT *, coalesce(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 0) AS fpos, coalesce(2.0::DOUBLE * tn / nullif(2 * tn + fp + fn, 0), 0) AS fneg FROM k)")
+ f"SELECT model, tp, fp, fn, tn, {R('(fpos + fneg) / 2')} AS macro_f1, {R('(fpos * (tp + fn) + fneg * (tn + fp)) / (tp + fp + fn + tn)')} AS weighted_f1 FROM g")
def confusion_matrix(spark: SparkSession, sf: str) -> DataFrame:
    s = T.scores(spark, sf).withColumn("pred", (F.coalesce("prob", F.lit(0.5)) >= 0.5).cast("int"))
    return rr(metrics.with_f1(metrics.confusion(s, ["model"])), "macro_f1", "weighted_f1")


SUMMED = [f"{m}_{t}" for m in ("accuracy", "f1", "auc") for t in ("mean", "std")]
SPLIT_SUMMARY = [*MODEL_SPLIT, "ss AS (SELECT model, " + ", ".join(f"{f}({m}) AS {m}_{t}" for m in ("accuracy", "f1", "auc") for t, f in (("mean", "avg"), ("std", "stddev_samp"))) + ", count(DISTINCT split_num) AS n_splits FROM bin GROUP BY 1)"]


def _split_summary(spark: SparkSession, sf: str) -> DataFrame:
    per = metrics.binary_scores(T.scores(spark, sf), ("model", "split_num"))
    return reports.split_summary(per, "model", ("accuracy", "f1", "auc"), [F.col("auc_mean").desc_nulls_last(), F.col("f1_mean").desc_nulls_last()])


@query(with_(*SPLIT_SUMMARY) + f"SELECT model, {rounded_sql(*SUMMED)}, n_splits, CAST(row_number() OVER (ORDER BY auc_mean DESC NULLS LAST, f1_mean DESC NULLS LAST, model) AS INTEGER) AS rank FROM ss")
def split_summary(spark: SparkSession, sf: str) -> DataFrame:
    return rr(_split_summary(spark, sf), *SUMMED)


@query(with_(*SPLIT_SUMMARY) + " UNION ALL ".join(f"SELECT '{m}' AS metric, {R('a.' + m)} AS value_a, {R('b.' + m)} AS value_b, {R(f'a.{m} - b.{m}')} AS delta FROM ss a, ss b WHERE a.model = 'transformer' AND b.model = 'gru'" for m in ("accuracy_mean", "f1_mean", "auc_mean")))
def pairwise_delta(spark: SparkSession, sf: str) -> DataFrame:
    out = reports.pairwise_delta(_split_summary(spark, sf), "model", ("accuracy_mean", "f1_mean", "auc_mean"), "transformer", "gru")
    return rr(out, "value_a", "value_b", "delta")


@query(with_(
    *SCORED, "sc AS (SELECT model, CASE WHEN sample_id % 4 < 2 THEN 'adaptive' ELSE 'native' END AS scenario, label, prob FROM probs)", *binary_sql("model, scenario", "sc"),
    "single AS (SELECT * FROM bin QUALIFY row_number() OVER (PARTITION BY model ORDER BY CASE WHEN scenario = 'native' AND model <> 'gru' THEN 0 ELSE 1 END, auc DESC NULLS LAST, scenario) = 1)",
    """ens AS (SELECT 'soft_vote' AS model, 'all' AS scenario, label, avg(prob) AS prob FROM probs GROUP BY sample_id, label
  UNION ALL SELECT 'best_of', 'all', label, max(prob) FROM probs GROUP BY sample_id, label)""", *binary_sql("model, scenario", "ens", "eb"),
    "top1 AS (SELECT * FROM eb ORDER BY auc DESC NULLS LAST, f1 DESC NULLS LAST, recall DESC NULLS LAST, model LIMIT 1)", "u AS (SELECT * FROM single UNION ALL SELECT * FROM top1)",
) + f"SELECT model, scenario, n, {rounded_sql(*BINARY)}, CAST(row_number() OVER (ORDER BY auc DESC NULLS LAST, f1 DESC NULLS LAST, recall DESC NULLS LAST, model) AS INTEGER) AS rank FROM u")
def model_comparison(spark: SparkSession, sf: str) -> DataFrame:
    s = T.scores(spark, sf)
    half = F.when(F.col("sample_id") % 4 < 2, "adaptive").otherwise("native")
    # Only gru has no preferred scenario, so its best one by AUC stands in.
    scen = s.withColumn("scenario", F.when(F.col("model") == "gru", F.concat(half, F.lit("*"))).otherwise(half))
    models = metrics.binary_scores(scen, ("model", "scenario"))
    both = s.groupBy("sample_id", "label").agg(F.avg("prob").alias("soft_vote"), F.max("prob").alias("best_of"))
    ens = both.unpivot(["sample_id", "label"], ["soft_vote", "best_of"], "model", "prob").withColumn("scenario", F.lit("all"))
    out = reports.model_comparison(models, metrics.binary_scores(ens, ("model", "scenario")), "native")
    return rr(out.withColumn("scenario", F.replace("scenario", F.lit("*"), F.lit(""))), *BINARY)


@query(with_(*FILLS, """imp AS (SELECT method, split_num, location || ':' || variable AS feature, avg(abs(truth - filled)) AS importance FROM fills WHERE filled IS NOT NULL GROUP BY 1, 2, 3)""",
"mm AS (SELECT method, feature, avg(importance) AS importance FROM imp GROUP BY 1, 2)")
+ f"SELECT method, feature, {R('importance')} AS importance, CAST(row_number() OVER (PARTITION BY method ORDER BY importance DESC, feature) AS INTEGER) AS rank FROM mm QUALIFY row_number() OVER (PARTITION BY method ORDER BY importance DESC, feature) <= 8")
def topk_importance(spark: SparkSession, sf: str) -> DataFrame:
    """Where a method errs most: site and variable as feature, mean over splits, top 8."""
    f = study.fills(spark, sf).filter(F.col("filled").isNotNull())
    imp = f.groupBy("method", "split_num", F.concat_ws(":", "location", "variable").alias("feature")).agg(
        F.avg(F.abs(F.col("truth") - F.col("filled"))).alias("importance")
    )
    return rr(reports.topk_importance(imp, ["method"], 8), "importance")


@query(with_(*cells_sql("nation"), donors_sql("nation"), pairs_sql(), "b AS (SELECT * FROM pairs WHERE value IS NOT NULL AND donor_value IS NOT NULL)")
+ f"""SELECT location, donor, variable, count(*) AS n, {R('covar_pop(value, donor_value) / nullif(sqrt(var_pop(value) * var_pop(donor_value)), 0)')} AS r,
  {R('CASE WHEN var_pop(value) > 0 THEN regr_slope(donor_value, value) END')} AS slope, {R('CASE WHEN var_pop(value) > 0 THEN regr_intercept(donor_value, value) END', 2)} AS intercept FROM b GROUP BY 1, 2, 3""")
def site_correlation(spark: SparkSession, sf: str) -> DataFrame:
    pairs = with_donor(cells(spark, sf, "nation"), T.donors(spark, sf, "nation"))
    out = reports.pair_fit(pairs)
    return out.select("location", "donor", "variable", "n", r("r").alias("r"), r("slope").alias("slope"), r("intercept", 2).alias("intercept"))


HIST = ", ".join(f"CAST(sum(CASE WHEN b = {i} THEN 1 ELSE 0 END) AS BIGINT) AS bin_{i}" for i in range(10))


@query(with_(*FILLS, "e AS (SELECT method, variable, round(abs(truth - filled) + 1e-8, 4) AS err FROM fills WHERE filled IS NOT NULL)", "h AS (SELECT *, least(greatest(floor((err - 0.0) / 100.0::DOUBLE), 0), 9) AS b FROM e)")
+ f"SELECT method, variable, {R('avg(err)')} AS mean, {HIST}, {R('quantile_cont(err, 0.25)')} AS q1, {R('quantile_cont(err, 0.5)')} AS median, {R('quantile_cont(err, 0.75)')} AS q3 FROM h GROUP BY 1, 2")
def error_distribution(spark: SparkSession, sf: str) -> DataFrame:
    e = study.fills(spark, sf).select("method", "variable", r(F.abs(F.col("truth") - F.col("filled"))).alias("err"))
    return rr(metrics.error_distribution(e, ["method", "variable"], "err", 10, 0.0, 1000.0), "mean", "q1", "median", "q3")


@query(with_(*SCORED) + f"""SELECT split_num, {R('(p + n) / (2.0::DOUBLE * n)')} AS weight_0, {R('(p + n) / (2.0::DOUBLE * p)')} AS weight_1, {R('n / CAST(greatest(p, 1) AS DOUBLE)')} AS pos_weight
FROM (SELECT split_num, sum(label) AS p, sum(1 - label) AS n FROM wide GROUP BY 1)""")
def class_weights(spark: SparkSession, sf: str) -> DataFrame:
    one = T.scores(spark, sf).filter(F.col("model") == "lstm")
    return rr(metrics.class_weights(one, ["split_num"]), "weight_0", "weight_1", "pos_weight")


RISKY = """lv AS (SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN ' high risk ' WHEN '2-HIGH' THEN 'Moderate Risk' WHEN '3-MEDIUM' THEN 'LOW RISK' WHEN '4-NOT SPECIFIED' THEN 'Low Risk' ELSE 'Extreme' END AS predicted,
  CASE o_orderstatus WHEN 'F' THEN 'High Risk' WHEN 'O' THEN 'low risk' ELSE 'Moderate Risk' END AS actual FROM orders)"""
NORM = "CASE lower(trim({c})) WHEN 'high risk' THEN 'High Risk' WHEN 'moderate risk' THEN 'Moderate Risk' WHEN 'low risk' THEN 'Low Risk' ELSE {c} END"
NUM = "CASE {c} WHEN 'Low Risk' THEN 1 WHEN 'Moderate Risk' THEN 2 WHEN 'High Risk' THEN 3 END"


@query(with_(RISKY, f"nn AS (SELECT {NORM.format(c='predicted')} AS p, {NORM.format(c='actual')} AS a FROM lv)", f"q AS (SELECT p, a, {NUM.format(c='p')} AS pn, {NUM.format(c='a')} AS an FROM nn)")
+ "SELECT p = a AND pn IS NOT NULL AS correct, CAST(pn AS INTEGER) AS predicted_numeric, CAST(an AS INTEGER) AS actual_numeric, CAST(an - pn AS INTEGER) AS difference, CASE WHEN pn IS NULL THEN 'Invalid risk level: ' || p END AS error, count(*) AS n FROM q GROUP BY ALL")
def risk_compare(spark: SparkSession, sf: str) -> DataFrame:
    o = T.table(spark, sf, "orders")
    p, s = F.col("o_orderpriority"), F.col("o_orderstatus")
    lv = o.select(
        F.when(p == "1-URGENT", " high risk ").when(p == "2-HIGH", "Moderate Risk").when(p == "3-MEDIUM", "LOW RISK").when(p == "4-NOT SPECIFIED", "Low Risk").otherwise("Extreme").alias("predicted"),
        F.when(s == "F", "High Risk").when(s == "O", "low risk").otherwise("Moderate Risk").alias("actual"),
    )
    from lacuna.operators.forecast import compare_risk

    out = compare_risk(lv, "predicted", "actual").drop("predicted", "actual")
    return out.groupBy(*out.columns).agg(F.count(F.lit(1)).alias("n"))


@query(with_(*SCORED, *binary_sql("model, split_num", "probs")) + f"""SELECT model AS method_name, split_num, {R('auc')} AS auc,
  CASE WHEN split_num = 3 THEN 'Split 3 AUC may be uninformative (very low/zero bloom-event prevalence).' ELSE '' END AS note FROM bin""")
def per_split_auc(spark: SparkSession, sf: str) -> DataFrame:
    per = metrics.binary_scores(T.scores(spark, sf), ("model", "split_num")).withColumnRenamed("model", "method_name")
    return rr(reports.per_split_note(per), "auc")
