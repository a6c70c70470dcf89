"""Registered queries: features, splits for training, models, ensembles."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.functions import expr as E
from lacuna.operators import ensemble, features, masking, metrics, models, search, splits, temporal
from lacuna.operators.panel import sites_wide
from lacuna.plans.common import R, VARS, cells, cells_sql, labels_sql, order_days, panel_sql, r, rr, spined, spined_sql, with_
from lacuna.plans.gap_queries import YEARS, random_sql
from lacuna.plans.metric_queries import BINARY, SCORED, auc_sql, binary_sql, rounded_sql
from lacuna.session import fresh_path
from lacuna.sources import tables as T
from lacuna.sources.files import stored

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn
    return add


@query(with_(*spined_sql("region"), "w AS (SELECT obs_date, " + ", ".join(f"max(CASE WHEN location = '{s}' THEN {v} END) AS {v}_{s}" for v in VARS for s in ("ASIA", "EUROPE")) + " FROM spined GROUP BY 1)")
+ "SELECT obs_date, " + ", ".join(f"{R(f'{v}_ASIA - {v}_EUROPE')} AS delta_{v}" for v in VARS) + " FROM w")
def feat_site_delta(spark: SparkSession, sf: str) -> DataFrame:
    wide = sites_wide(spined(spark, sf, "region"), VARS, ["ASIA", "EUROPE"])
    out = features.site_delta(wide, VARS, "ASIA", "EUROPE")
    return out.select("obs_date", *[r(f"delta_{v}").alias(f"delta_{v}") for v in VARS])


def roll_sql(c: str, n: int) -> list[str]:
    f = f"OVER (PARTITION BY location ORDER BY obs_date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return [f"{R(f'avg({c}) {f}', 3)} AS {c}_mean{n}", f"{R(f'coalesce(stddev_samp({c}) {f}, 0)', 3)} AS {c}_std{n}"]


ROLL = [x for c in ("n_orders", "total") for n in features.ROLLING_ROWS for x in roll_sql(c, n)]


@query(with_(*spined_sql("nation")) + "SELECT location, obs_date, " + ", ".join(ROLL) + " FROM spined")
def feat_rolling(spark: SparkSession, sf: str) -> DataFrame:
    out = features.rolling(spined(spark, sf, "nation").select("location", "obs_date", "n_orders", "total"), ["n_orders", "total"], regular=True)
    names = [c for c in out.columns if c[-1].isdigit()]
    return rr(out.select("location", "obs_date", *names), *names, digits=3)


LAGS = [f"total_lag{n}" for n in features.LAG_ROWS]


@query(with_(*spined_sql("nation"), "l AS (SELECT location, obs_date, " + ", ".join(f"lag(total, {n}) OVER (PARTITION BY location ORDER BY obs_date) AS total_lag{n}" for n in features.LAG_ROWS) + " FROM spined)")
+ "SELECT location, obs_date, " + ", ".join(f"{R(f'coalesce({c}, avg({c}) OVER (PARTITION BY location))')} AS {c}" for c in LAGS) + " FROM l")
def feat_lag(spark: SparkSession, sf: str) -> DataFrame:
    out = features.lags(spined(spark, sf, "nation").select("location", "obs_date", "total"), ["total"], regular=True)
    return rr(out.drop("total"), *LAGS)


IRREGULAR_ROLL = [x for n in (7, 30, 2000) for x in roll_sql("total", n)]
IRREGULAR_LAGS = (1, 30, 300)


@query(with_(*panel_sql("nation"), "l AS (SELECT *, " + ", ".join(f"lag(total, {n}) OVER (PARTITION BY location ORDER BY obs_date) AS l{n}" for n in IRREGULAR_LAGS) + " FROM panel)")
+ "SELECT location, obs_date, " + ", ".join([*IRREGULAR_ROLL, *[f"{R(f'coalesce(l{n}, avg(l{n}) OVER (PARTITION BY location))', 3)} AS total_lag{n}" for n in IRREGULAR_LAGS]])
+ f""", {R('total - avg(total) OVER (PARTITION BY location ORDER BY obs_date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)', 3)} AS total_anomaly FROM l""")
def feat_rolling_irregular(spark: SparkSession, sf: str) -> DataFrame:
    """Frames of rows on a panel without rows for quiet days; the longest looks back 2,000 rows."""
    panel = T.orders_panel(spark, sf, "nation")
    rolled = features.rolling(panel, ["total"], (7, 30, 2000))
    lagged = features.lags(rolled, ["total"], IRREGULAR_LAGS)
    out = features.derived(lagged, "total", "balance")
    names = [c for c in out.columns if c.startswith("total_")]
    return rr(out.select("location", "obs_date", *names), *names, digits=3)


@query(with_(*spined_sql("nation")) + "SELECT location, obs_date, CAST(dayofyear(obs_date) AS INTEGER) AS day_of_year, CAST(month(obs_date) AS INTEGER) AS month, CASE WHEN month(obs_date) BETWEEN 6 AND 10 THEN 1 ELSE 0 END AS is_wet_season FROM spined")
def feat_calendar(spark: SparkSession, sf: str) -> DataFrame:
    return features.calendar(spined(spark, sf, "nation").select("location", "obs_date"))


@query(with_(*spined_sql("nation")) + f"""SELECT location, obs_date, {R('total - avg(total) OVER (PARTITION BY location ORDER BY obs_date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)', 3)} AS total_anomaly,
  {R('CASE WHEN balance IS NOT NULL THEN greatest(0.0, balance - 29.5) END')} AS balance_stress FROM spined""")
def feat_derived(spark: SparkSession, sf: str) -> DataFrame:
    out = features.derived(spined(spark, sf, "nation"), "total", "balance", regular=True)
    return out.select("location", "obs_date", r("total_anomaly", 3).alias("total_anomaly"), r("balance_stress").alias("balance_stress"))


@query(with_(*cells_sql("region"), random_sql("0.2::DOUBLE"), "f AS (SELECT location, obs_date, variable FROM masked WHERE is_masked)")
+ "SELECT s.location, s.obs_date, " + ", ".join(f"CAST(max(CASE WHEN f.variable = '{v}' THEN 1 ELSE 0 END) AS INTEGER) AS {v}_was_imputed" for v in VARS)
+ " FROM spined s LEFT JOIN f ON f.location = s.location AND f.obs_date = s.obs_date GROUP BY 1, 2")
def feat_flags(spark: SparkSession, sf: str) -> DataFrame:
    mask = masking.Strategy("random_20").apply(cells(spark, sf, "region"))
    return features.imputation_flags(spined(spark, sf, "region").select("location", "obs_date"), mask, VARS)


MATRIX = ["total", "total_mean7", "total_std7", "total_mean30", "total_lag1", "total_lag30", "n_orders_lag7", "total_anomaly", "balance_stress"]


def _matrix(spark: SparkSession, sf: str) -> DataFrame:
    return features.feature_matrix(spined(spark, sf, "region"), ["n_orders", "total"], None, "total", "balance", regular=True)


_W = "PARTITION BY location ORDER BY obs_date"
MATRIX_SQL = [
    *spined_sql("region"),
    f"""fm0 AS (SELECT location, obs_date, total, avg(total) OVER ({_W} ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS total_mean7,
    coalesce(stddev_samp(total) OVER ({_W} ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 0) AS total_std7, avg(total) OVER ({_W} ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS total_mean30,
    lag(total, 1) OVER ({_W}) AS l1, lag(total, 30) OVER ({_W}) AS l30, lag(n_orders, 7) OVER ({_W}) AS n7,
    total - avg(total) OVER ({_W} ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS total_anomaly, CASE WHEN balance IS NOT NULL THEN greatest(0.0, balance - 29.5) END AS balance_stress FROM spined)""",
    """fm AS (SELECT *, coalesce(l1, avg(l1) OVER (PARTITION BY location)) AS total_lag1, coalesce(l30, avg(l30) OVER (PARTITION BY location)) AS total_lag30,
    coalesce(n7, avg(n7) OVER (PARTITION BY location)) AS n_orders_lag7, CAST(dayofyear(obs_date) AS INTEGER) AS day_of_year FROM fm0)""",
]


@query(with_(*MATRIX_SQL) + f"SELECT location, obs_date, day_of_year, {rounded_sql(*MATRIX, digits=3)} FROM fm")
def feature_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return rr(_matrix(spark, sf).select("location", "obs_date", "day_of_year", *MATRIX), *MATRIX, digits=3)


@query(with_(*MATRIX_SQL) + f"SELECT location, {', '.join(f'{R(f'avg({c})', 3)} AS {c}' for c in ['day_of_year', *MATRIX])} FROM fm GROUP BY 1")
def numeric_features(spark: SparkSession, sf: str) -> DataFrame:
    """Means of all numeric columns of the feature matrix but those on the deny list."""
    rows = _matrix(spark, sf).select("location", "obs_date", "day_of_year", "balance", "month", "is_wet_season", *MATRIX)
    names = features.numeric_features(rows, ("balance", "month", "is_wet_season"))
    return rows.groupBy("location").agg(*[r(F.avg(c), 3).alias(c) for c in names])


@query(with_(*MATRIX_SQL, YEARS, """tt AS (SELECT s.split_num, f.*, CASE WHEN f.obs_date <= s.cutoff THEN 'train' ELSE 'test' END AS role FROM fm f JOIN ysplits s
    ON f.obs_date <= s.cutoff OR f.obs_date BETWEEN s.test_start AND s.test_end WHERE f.total IS NOT NULL)""")
+ f"SELECT CAST(split_num AS INTEGER) AS split_num, role, count(*) AS n, {R('avg(coalesce(total_lag1, 0))', 3)} AS total_lag1, {R('avg(coalesce(balance_stress, 0))', 3)} AS balance_stress FROM tt GROUP BY 1, 2")
def train_test_split(spark: SparkSession, sf: str) -> DataFrame:
    rows = features.train_test(_matrix(spark, sf), splits.yearly_splits(1996, 5, 2), "total", MATRIX[1:])
    return rows.groupBy("split_num", "role").agg(
        F.count(F.lit(1)).alias("n"), r(F.avg("total_lag1"), 3).alias("total_lag1"), r(F.avg("balance_stress"), 3).alias("balance_stress")
    )


@query(with_(*spined_sql("region")) + "SELECT location, obs_date, row_number() OVER (PARTITION BY location ORDER BY obs_date) > floor(count(*) OVER (PARTITION BY location) * 0.8::DOUBLE) AS is_validation FROM spined WHERE total IS NOT NULL")
def inner_validation_split(spark: SparkSession, sf: str) -> DataFrame:
    known = spined(spark, sf, "region").filter(F.col("total").isNotNull()).select("location", "obs_date")
    return splits.inner_validation(known, 0.8, ["location"])


@query(with_(*labels_sql()) + """SELECT location, CAST(sum(CASE WHEN label >= 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS half_up, CAST(sum(CASE WHEN label > 0 THEN 1 ELSE 0 END) AS BIGINT) AS above_zero,
  CAST(sum(CASE WHEN label >= 1.0 THEN 1 ELSE 0 END) AS BIGINT) AS full, count(label) AS n FROM label_rows GROUP BY 1""")
def label_binarise(spark: SparkSession, sf: str) -> DataFrame:
    lab = F.col("label")
    return T.urgent_labels(spark, sf).groupBy("location").agg(
        F.sum(E.binarise(lab, 0.5)).alias("half_up"), F.sum(E.binarise(lab, 0.0, inclusive=False)).alias("above_zero"),
        F.sum(E.binarise(lab, 1.0)).alias("full"), F.count("label").alias("n"),
    )


LAB = """lp AS (SELECT p.location, p.obs_date, p.total, CASE WHEN p.n_orders >= 2 THEN 1 ELSE 0 END AS label FROM spined p WHERE p.total IS NOT NULL)"""


@query(with_(*spined_sql("region"), LAB) + f"""SELECT location, obs_date AS window_end, target_date, target, {R('mean_', 3)} AS mean_total, {R('first_', 3)} AS first_total FROM (
  SELECT *, lead(obs_date) OVER w AS target_date, lead(label) OVER w AS target, avg(total) OVER (PARTITION BY location ORDER BY obs_date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS mean_,
    lag(total, 29) OVER w AS first_, row_number() OVER w AS rn FROM lp WINDOW w AS (PARTITION BY location ORDER BY obs_date)) WHERE rn >= 30 AND target_date IS NOT NULL""")
def sequence_windows(spark: SparkSession, sf: str) -> DataFrame:
    lab = spined(spark, sf, "region").filter(F.col("total").isNotNull()).select(
        "location", "obs_date", "total", F.when(F.col("n_orders") >= 2, 1).otherwise(0).alias("label")
    )
    seq = features.sequences(lab, ["total"], "label")
    total = F.aggregate(F.transform("sequence", lambda x: x["total"]), F.lit(0.0), lambda a, x: a + x)
    return seq.select(
        "location", "window_end", "target_date", "target", r(total / 30, 3).alias("mean_total"), r(F.col("sequence")[0]["total"], 3).alias("first_total")
    )


@query(with_(*spined_sql("region"), YEARS, """tt AS (SELECT CAST(s.split_num AS INTEGER) AS split_num, p.location, p.obs_date, p.total, p.balance, CASE WHEN p.obs_date <= s.cutoff THEN 'train' ELSE 'test' END AS role
  FROM spined p JOIN ysplits s ON p.obs_date <= s.cutoff OR p.obs_date BETWEEN s.test_start AND s.test_end)""",
"mm AS (SELECT split_num, min(total) AS tl, max(total) AS th, min(balance) AS bl, max(balance) AS bh FROM tt WHERE role = 'train' GROUP BY 1)")
+ f"""SELECT split_num, location, obs_date, {R('coalesce((total - tl) / CASE WHEN th = tl THEN 1 ELSE th - tl END * 2 - 1, 0)')} AS total,
  {R('coalesce((balance - bl) / CASE WHEN bh = bl THEN 1 ELSE bh - bl END * 2 - 1, 0)')} AS balance FROM tt JOIN mm USING (split_num) WHERE role = 'test'""")
def scale_minmax(spark: SparkSession, sf: str) -> DataFrame:
    rows = splits.assign_roles(spined(spark, sf, "region").select("location", "obs_date", "total", "balance"), splits.yearly_splits(1996, 5, 2))
    scaler = features.MinMax.fit(rows.filter(F.col("role") == "train"), ["total", "balance"], lo=-1.0, hi=1.0)
    out = scaler.transform(rows.filter(F.col("role") == "test")).drop("role")
    return rr(out.select("split_num", "location", "obs_date", "total", "balance"), "total", "balance")


# --- ensembles -----------------------------------------------------------------

S = "split_num, sample_id, label"
LIVE = "live AS (SELECT split_num, model FROM probs GROUP BY 1, 2 HAVING count(prob) > 0)"


@query(with_(*SCORED) + f"SELECT {S}, {R('avg(prob)', 6)} AS prob FROM probs GROUP BY {S}")
def ens_soft_vote(spark: SparkSession, sf: str) -> DataFrame:
    return rr(ensemble.soft_vote(T.scores(spark, sf)), "prob", digits=6)


def weighted_sql(weights: str, on: str, name: str = "ens") -> list[str]:
    return [
        f"""{name}_j AS (SELECT p.*, greatest(coalesce(w.weight, 1), 0) AS wt FROM probs p JOIN live USING (split_num, model) LEFT JOIN {weights} w USING ({on}))""",
        f"""{name} AS (SELECT {S}, CASE WHEN count(prob) = count(*) THEN CASE WHEN sum(wt) > 0 THEN sum(prob * wt) / sum(wt) ELSE avg(prob) END END AS prob FROM {name}_j GROUP BY {S})""",
    ]


WEIGHTS = "wts AS (SELECT model, CASE model WHEN 'lstm' THEN count(prob) / 1000.0::DOUBLE WHEN 'gru' THEN -1 WHEN 'xgboost' THEN avg(prob) END AS weight FROM probs GROUP BY 1)"


@query(with_(*SCORED, LIVE, WEIGHTS, *weighted_sql("wts", "model")) + f"SELECT {S}, {R('prob', 6)} AS prob FROM ens")
def ens_weighted(spark: SparkSession, sf: str) -> DataFrame:
    """Weights of all kinds: positive, negative (clipped), missing (counts as 1)."""
    p = T.scores(spark, sf)
    m = F.col("model")
    w = p.groupBy("model").agg(F.count("prob").alias("c"), F.avg("prob").alias("a")).select(
        "model", F.when(m == "lstm", F.col("c") / F.lit(1000.0)).when(m == "gru", F.lit(-1.0)).when(m == "xgboost", F.col("a")).alias("weight")
    )
    return rr(ensemble.weighted(p, w), "prob", digits=6)


AUCW = [
    "known AS (SELECT * FROM probs WHERE prob IS NOT NULL)", auc_sql("split_num, model", "known"),
    "aw AS (SELECT split_num, model, coalesce(auc, 0) AS weight FROM auc)", *weighted_sql("aw", "split_num, model", "aens"),
]


@query(with_(*SCORED, LIVE, *AUCW) + f"SELECT {S}, {R('prob', 6)} AS prob FROM aens")
def ens_auc_weighted(spark: SparkSession, sf: str) -> DataFrame:
    p = T.scores(spark, sf)
    return rr(ensemble.weighted(p, ensemble.auc_weights(p), ("split_num", "model")), "prob", digits=6)


TOTAL = sum(ensemble.PRODUCTION_WEIGHTS.values())


@query(with_(*SCORED) + f"""SELECT {S}, {R("CASE WHEN count(prob) = 4 THEN sum(prob * w) END", 6)} AS prob FROM (SELECT *, CASE model {' '.join(f"WHEN '{k}' THEN {v}::DOUBLE / {TOTAL!r}::DOUBLE" for k, v in ensemble.PRODUCTION_WEIGHTS.items())} END AS w FROM probs) GROUP BY {S}""")
def ens_fixed_weights(spark: SparkSession, sf: str) -> DataFrame:
    return rr(ensemble.fixed_weights(T.scores(spark, sf)), "prob", digits=6)


@query(with_(
    *SCORED, LIVE, *AUCW, f"sv AS (SELECT {S}, avg(prob) AS prob FROM probs GROUP BY {S})",
    f"strat AS (SELECT 'soft_vote' AS name, {S}, round(prob + 1e-10, 6) AS prob FROM sv UNION ALL SELECT 'weighted_avg', {S}, round(prob + 1e-10, 6) FROM aens)", *binary_sql("name, split_num", "strat"),
) + f"SELECT name, split_num, n, {rounded_sql(*BINARY)} FROM bin")
def ens_evaluate(spark: SparkSession, sf: str) -> DataFrame:
    p = T.scores(spark, sf)
    strategies = {
        "soft_vote": rr(ensemble.soft_vote(p), "prob", digits=6),
        "weighted_avg": rr(ensemble.weighted(p, ensemble.auc_weights(p), ("split_num", "model")), "prob", digits=6),
    }
    return rr(ensemble.evaluate(strategies), *BINARY)


@query()
def ens_stacked(spark: SparkSession, sf: str) -> DataFrame:
    p = stored(spark, T.scores(spark, sf), "scores")
    out = ensemble.stacked(p, ["gru", "lstm", "transformer", "xgboost"], [0, 1, 2, 3, 4, 5])
    return rr(out, "prob", digits=4)


# --- boosted trees -------------------------------------------------------------

TREE_FEATURES = ["n_orders_lag1", "n_orders_mean7", "n_orders_mean30", "total_lag1", "total_mean7", "total_std7", "day_of_year"]


def _training(spark: SparkSession, sf: str) -> DataFrame:
    """Feature matrix with roles, written once: boosting reads it many times."""
    rows = features.train_test(_matrix(spark, sf), splits.yearly_splits(2000, 1, 2), "total", TREE_FEATURES)
    return stored(spark, rows.withColumn("label", (F.col("balance") >= 4500).cast("int")), "training")


@query()
def gbt_regressor(spark: SparkSession, sf: str) -> DataFrame:
    """Early-stopped regression of the total; errors and event scores of the test year."""
    rows = _training(spark, sf)
    train = splits.inner_validation(rows.filter(F.col("role") == "train"), 0.8, ["location"])
    model = models.fit_regressor(train, TREE_FEATURES, "total", "is_validation", rounds=20)
    scored = models.predict(model, rows.filter(F.col("role") == "test"), TREE_FEATURES)
    out = metrics.regression_event_scores(scored, ["location"], "total", "prediction", 250.0)
    return rr(out, "rmse", "mae", "r2", "f1", "auc")


@query()
def gbt_random_search(spark: SparkSession, sf: str) -> DataFrame:
    rows = _training(spark, sf).filter(F.col("role") == "train")
    fitted = models.random_search(rows, TREE_FEATURES, "label", draws=2, folds=2, rounds=3)
    return models.search_report(spark, fitted)


def _searched(spark: SparkSession, sf: str) -> tuple[DataFrame, search.Ledger]:
    """Two splits, two draws of the whole space, two folds; boosting is cut to a few rounds (README: figures)."""
    rows = features.train_test(_matrix(spark, sf), splits.yearly_splits(1999, 2, 1), "total", TREE_FEATURES)
    rows = stored(spark, rows.withColumn("label", (F.col("balance") >= 4500).cast("int")).filter(F.col("label").isNotNull()), "searched")
    ledger = search.Ledger(spark, fresh_path(spark, "ledger"))
    draws = [d | {"n_estimators": 4, "max_depth": 3} for d in search.draw_params(2)]
    search.search(rows.filter(F.col("role") == "train"), TREE_FEATURES, "label", ledger, (1, 2), draws, folds=2)
    return rows, ledger


@query()
def gbt_search_ledger(spark: SparkSession, sf: str) -> DataFrame:
    """Every split and draw of the search with its folds and mean AUC."""
    return search.report(_searched(spark, sf)[1])


@query()
def gbt_refit(spark: SparkSession, sf: str) -> DataFrame:
    """Test scores of every split's best parameters, and whether the final model takes them."""
    rows, ledger = _searched(spark, sf)
    scores = stored(spark, metrics.binary_scores(search.scored_splits(rows, TREE_FEATURES, "label", ledger), ("split_num",)), "scores")
    _, params = search.refit(rows.filter(F.col("split_num") == 2), TREE_FEATURES, "label", ledger, scores)
    best = search.winners(ledger).select("split_num", "params", F.col("params").eqNullSafe(F.lit(json.dumps(params, sort_keys=True))).alias("taken"))
    return rr(scores.join(best, "split_num"), *BINARY)


@query()
def gbt_importance(spark: SparkSession, sf: str) -> DataFrame:
    rows = _training(spark, sf).filter(F.col("role") == "train")
    model = models.fit_regressor(rows, TREE_FEATURES, "total", rounds=10)
    return search.top_importance(spark, model, TREE_FEATURES).select("feature", "importance")


@query()
def method_split_eval(spark: SparkSession, sf: str) -> DataFrame:
    """Two imputers and two splits: fit on train, fill both, classify, score the test year."""
    wide = stored(
        spark,
        splits.assign_roles(spined(spark, sf, "region"), splits.yearly_splits(1999, 2)).withColumn(
            "label", F.when(F.col("balance").isNotNull(), (F.col("balance") >= 4500).cast("int"))
        ), "labelled",
    )
    use = ["n_orders", "total"]

    def by_means(train: DataFrame, test: DataFrame) -> tuple[DataFrame, DataFrame]:
        from lacuna.operators.panel import to_cells

        imputer = temporal.MeanImputer.fit(to_cells(train, use))

        def fill(df: DataFrame) -> DataFrame:
            filled = imputer.transform(to_cells(df, use)).groupBy("location", "obs_date").agg(
                *[F.max(F.when(F.col("variable") == v, F.col("filled"))).alias(v) for v in use]
            )
            return df.filter(F.col("label").isNotNull()).drop(*use).join(filled, ["location", "obs_date"])
        return fill(train), fill(test)

    def as_zero(train: DataFrame, test: DataFrame) -> tuple[DataFrame, DataFrame]:
        known = lambda df: df.filter(F.col("label").isNotNull()).fillna(0.0, subset=use)
        return known(train), known(test)

    out = models.evaluate_methods([1, 2], {"means": by_means, "zero": as_zero}, wide, use, "label", rounds=3)
    return rr(out, *BINARY)
