"""The imputation study: cut gaps, fill them with several methods, score the fills.

A masked data set is the cell panel with ``mask_type`` and ``split_num`` in front of the
variable name, so one pass of each method covers all data sets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.operators import hybrid, masking, metrics, spatial, temporal
from lacuna.operators.panel import with_donor
from lacuna.plans.common import (
    GAP, LINE, LINE_DAY, cells, cells_sql, donors_sql, neighbours_sql, order_days,
)
from lacuna.plans.gap_queries import PERIODS, SEASONAL_RATE, WET, block_sql, random_sql, rolling_sql
from lacuna.plans.impute_queries import COEF_OF, REGR3, parabola_sql
from lacuna.sources import tables as T
from lacuna.sources.files import stored

PATTERNS = tuple(masking.STRATEGIES)
#: Where variables are hidden together, it is these in these periods.
OPTIONS = {"cross_variable": {"variables": ("balance", "total"), "periods": PERIODS}}
#: All methods that fill one variable at a time; similar days and leading modes, which see all at once, have keys of their own.
STUDY_METHODS = (
    "linear", "climatology", "kriging", "cross_regression", "distance_weighted", "advection", "hybrid_sequential", "hybrid_adaptive", "hybrid_ensemble",
)
_STORED: dict[tuple[str, str, str], DataFrame] = {}


def _kept(spark: SparkSession, sf: str, name: str, build) -> DataFrame:
    """Written once per session and data set, since many reports start from it."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _STORED:
        _STORED[key] = stored(spark, build(), name)
    return _STORED[key]


def forget() -> None:
    """Start the next report from the raw tables again."""
    _STORED.clear()


def masked_sets(spark: SparkSession, sf: str, patterns=PATTERNS) -> DataFrame:
    """(mask_type, split_num, location, variable, obs_date, value with holes, truth, is_masked)."""
    panel = _kept(spark, sf, "cells", lambda: cells(spark, sf, "region"))
    out = None
    for name in patterns:
        m = masking.Strategy(name, OPTIONS.get(name, {})).apply(panel, bounds=order_days(spark, sf))
        if "split_num" not in m.columns:
            m = m.withColumn("split_num", F.lit(1))
        m = m.select(
            F.lit(name).alias("mask_type"), "split_num", "location", "variable", "obs_date", "value", "is_masked"
        )
        out = m if out is None else out.unionByName(m)
    return masking.apply_mask(out)


def qualified(masked: DataFrame) -> DataFrame:
    return masked.withColumn("variable", F.concat_ws("/", "mask_type", "split_num", "variable")).drop("mask_type", "split_num")


def split_names(df: DataFrame) -> DataFrame:
    p = F.split("variable", "/")
    return df.select(
        p[0].alias("mask_type"), p[1].cast("int").alias("split_num"), p[2].alias("variable"),
        *[c for c in df.columns if c != "variable"],
    )


def fills(spark: SparkSession, sf: str, methods=STUDY_METHODS) -> DataFrame:
    """Masked cells of every data set with the estimate of every method."""
    def build() -> DataFrame:
        data = _kept(spark, sf, "masked", lambda: qualified(masked_sets(spark, sf)))
        table = hybrid.registry(T.donors(spark, sf, "region"), single=True)
        out = None
        for m in methods:
            one = table[m](data).filter(F.col("is_masked") & F.col("truth").isNotNull()).select(
                "location", "variable", "obs_date", "truth", F.lit(m).alias("method"), "filled"
            )
            out = one if out is None else out.unionByName(one)
        return split_names(out)
    return _kept(spark, sf, "fills", build)


def results(spark: SparkSession, sf: str) -> DataFrame:
    """One row per data set, method, variable and location."""
    by = ["mask_type", "split_num", "method", "variable", "location"]
    scored = metrics.fill_scores(fills(spark, sf), by)
    name = F.lit(None).cast("string")
    for k, (text, _) in hybrid.METHODS.items():
        name = F.when(F.col("method") == k, F.lit(text)).otherwise(name)
    return scored.withColumn("method_name", name)


# --- SQL -----------------------------------------------------------------------

KEYS = "mask_type, split_num, location, variable"
_CROSS = " OR ".join(f"obs_date BETWEEN DATE '{lo}' AND DATE '{hi}'" for lo, hi in PERIODS)
_ROLL180 = [x.replace("bounds", "bounds180").replace("splits", "splits180") for x in rolling_sql(180, name="m_roll180")]
_PARTS = {
    "random_10": "m_random", "random_20": "m_random20", "block_7day": "m_block", "block_14day": "m_block14", "seasonal": "m_season", "cross_variable": "m_cross",
    "rolling_origin": "m_roll", "rolling_origin_180": "m_roll180",
}
_SETS = [
    *cells_sql("region"), donors_sql("region"),
    random_sql("0.1::DOUBLE", name="m_random"), random_sql("0.2::DOUBLE", name="m_random20"), *block_sql(7, 8, name="m_block"), *block_sql(14, 4, name="m_block14"),
    random_sql(SEASONAL_RATE, f"variable, {WET}", name="m_season"),
    f"m_cross AS (SELECT *, value IS NOT NULL AND variable IN ('balance', 'total') AND ({_CROSS}) AS is_masked FROM cells)", *rolling_sql(name="m_roll"), *_ROLL180,
    "sets AS (" + "\n  UNION ALL ".join(
        f"SELECT '{k}' AS mask_type, {'split_num' if k.startswith('rolling') else '1 AS split_num'}, location, variable, obs_date, value AS truth, is_masked FROM {m}" for k, m in _PARTS.items()
    ) + ")",
    "holed AS MATERIALIZED (SELECT *, CASE WHEN NOT is_masked THEN truth END AS value FROM sets)",
]
_T = f"coalesce({LINE}, pval, nval)"
_W = f"CASE WHEN {GAP} < 3 THEN 0.8::DOUBLE WHEN {GAP} > 14 THEN 0.3::DOUBLE ELSE 0.5::DOUBLE END"
_ADAPTIVE = f"CASE WHEN {GAP} < 7 THEN {LINE_DAY} WHEN {GAP} <= 30 THEN coalesce({parabola_sql('day')}, {LINE_DAY}) ELSE md END"


def _same(a: str, b: str) -> str:
    """Same data set and variable, of whatever site."""
    return " AND ".join(f"{a}.{k} = {b}.{k}" for k in ("mask_type", "split_num", "variable"))


FILLS = [
    *_SETS, *neighbours_sql("holed", KEYS),
    f"hl AS (SELECT *, lag(value, 1) OVER w AS l1, lag(value, 7) OVER w AS l7 FROM holed WINDOW w AS (PARTITION BY {KEYS} ORDER BY obs_date))",
    f"""hp AS MATERIALIZED (SELECT c.*, x.donor, d.value AS donor_value, d.value AS x0, d.l1 AS x1, d.l7 AS x2 FROM holed c JOIN donors x ON x.target = c.location
  LEFT JOIN hl d ON d.location = x.donor AND d.obs_date = c.obs_date AND {_same('d', 'c')})""",
    f"""hk AS (SELECT {KEYS}, avg(value) AS mt, avg(donor_value) AS md, CASE WHEN var_pop(donor_value) > 0 THEN covar_samp(value, donor_value) / var_pop(donor_value) ELSE 0 END AS w
  FROM hp WHERE value IS NOT NULL AND donor_value IS NOT NULL GROUP BY {KEYS} HAVING count(*) >= 20)""",
    f"""mom AS (SELECT {KEYS}, avg(value) AS my, avg(x0) AS m0, avg(x1) AS m1, avg(x2) AS m2, covar_pop(x0, value) AS y0, covar_pop(x1, value) AS y1, covar_pop(x2, value) AS y2,
    covar_pop(x0, x0) AS c00, covar_pop(x0, x1) AS c01, covar_pop(x0, x2) AS c02, covar_pop(x1, x1) AS c11, covar_pop(x1, x2) AS c12, covar_pop(x2, x2) AS c22
  FROM hp WHERE value IS NOT NULL AND x0 IS NOT NULL AND x1 IS NOT NULL AND x2 IS NOT NULL GROUP BY {KEYS} HAVING count(*) >= 10)""",
    COEF_OF.format(keys=KEYS),
    f"hc AS (SELECT {KEYS}, dayofyear(obs_date) AS doy, avg(value) AS m FROM holed GROUP BY {KEYS}, dayofyear(obs_date))",
    f"""lg AS (SELECT t.mask_type, t.split_num, t.location, t.variable, x.donor, lag, covar_pop(t.value, d.value) / nullif(sqrt(var_pop(t.value) * var_pop(d.value)), 0) AS r
  FROM (SELECT * FROM holed WHERE value IS NOT NULL) t JOIN donors x ON x.target = t.location CROSS JOIN (SELECT unnest(generate_series(0, 7))::INTEGER AS lag)
  JOIN (SELECT * FROM holed WHERE value IS NOT NULL) d ON d.location = x.donor AND d.obs_date = t.obs_date - lag AND {_same('d', 't')} GROUP BY ALL HAVING count(*) > 20)""",
    f"bl AS (SELECT * FROM lg WHERE r > -1 QUALIFY row_number() OVER (PARTITION BY {KEYS} ORDER BY round(r, 12) DESC, lag) = 1)",
    f"""ad AS (SELECT b.mask_type, b.split_num, b.location, b.variable, d.obs_date + b.lag AS obs_date, d.value AS moved FROM bl b JOIN holed d ON d.location = b.donor AND {_same('d', 'b')} WHERE d.value IS NOT NULL)""",
    f"ga0 AS (SELECT *, avg(value) OVER (PARTITION BY {KEYS}, month(obs_date), day(obs_date)) AS md FROM nb)",
    f"ga1 AS (SELECT {KEYS}, obs_date, coalesce(value, {_ADAPTIVE}) AS v FROM ga0)",
    f"""ga AS (SELECT {KEYS}, obs_date, coalesce(v, last_value(v IGNORE NULLS) OVER (PARTITION BY {KEYS} ORDER BY obs_date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    first_value(v IGNORE NULLS) OVER (PARTITION BY {KEYS} ORDER BY obs_date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS adaptive FROM ga1)""",
    f"""est AS MATERIALIZED (SELECT nb.mask_type, nb.split_num, nb.location, nb.variable, nb.obs_date, nb.truth, {_T} AS linear, {LINE} AS inside, hc.m AS climatology,
    hk.mt + hk.w * (p.donor_value - hk.md) AS kriging, {_W} AS wt, {REGR3} AS cross_regression, p.donor_value AS distance_weighted, ad.moved AS advection, ga.adaptive AS hybrid_adaptive
  FROM nb JOIN hp p USING ({KEYS}, obs_date) LEFT JOIN hk USING ({KEYS}) LEFT JOIN coef k USING ({KEYS}) LEFT JOIN ad USING ({KEYS}, obs_date) JOIN ga USING ({KEYS}, obs_date)
  LEFT JOIN hc ON hc.location = nb.location AND {_same('hc', 'nb')} AND hc.doy = dayofyear(nb.obs_date)
  WHERE nb.is_masked AND nb.truth IS NOT NULL)""",
    "fills AS (" + "\n  UNION ALL ".join(f"SELECT mask_type, split_num, location, variable, obs_date, truth, '{m}' AS method, {e} AS filled FROM est" for m, e in {
        "linear": "linear", "climatology": "climatology", "kriging": "kriging", "cross_regression": "cross_regression", "distance_weighted": "distance_weighted",
        "advection": "advection", "hybrid_sequential": "coalesce(inside, cross_regression)", "hybrid_adaptive": "hybrid_adaptive",
        "hybrid_ensemble": "coalesce(wt * linear + (1 - wt) * kriging, linear, kriging)",
    }.items()) + ")",
]
NAMES = "CASE method " + " ".join(f"WHEN '{k}' THEN '{v[0]}'" for k, v in hybrid.METHODS.items()) + " END"


def scores_sql(by: str, src: str = "fills", name: str = "results") -> str:
    return f"""{name} AS (SELECT {by}, count(*) AS missing_count, count(e) AS filled_count, count(e) / count(*) AS coverage,
    sqrt(avg(e * e)) AS rmse, avg(abs(e)) AS mae, 1 - sum(e * e) / nullif(var_pop(y) * count(y), 0) AS r2
  FROM (SELECT *, truth - filled AS e, CASE WHEN filled IS NOT NULL THEN truth END AS y FROM {src}) GROUP BY {by})"""


RESULTS = [*FILLS, scores_sql("mask_type, split_num, method, variable, location", name="results0"), f"results AS (SELECT *, {NAMES} AS method_name FROM results0)"]
