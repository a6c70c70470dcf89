"""Registered queries: temporal, spatial and hybrid imputation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.functions.scan import exact_quantiles
from lacuna.operators import coast, features, hybrid, joint, masking, modes, spatial, spline, temporal, zonal
from lacuna.operators.panel import to_cells, to_wide, with_donor
from lacuna.plans.common import (
    DAYS, GAP, LINE, LINE_DAY, R, VARS, cells, cells_sql, donors_sql, neighbours_sql, order_days, pairs_sql, panel_sql, r,
    rr, spined, spined_sql, unpivot_sql, with_,
)
from lacuna.plans.gap_queries import rolling_sql
from lacuna.sources import tables as T

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn
    return add


def holes(df: DataFrame, digits: int = 4) -> DataFrame:
    """The cells a method had to fill."""
    return df.filter(F.col("value").isNull()).select("location", "variable", "obs_date", r("filled", digits).alias("filled"))


def fill_sql(expression: str, *ctes: str, src: str = "nb", digits: int = 4) -> str:
    return with_(*ctes) + f"SELECT location, variable, obs_date, {R(expression, digits)} AS filled FROM {src} WHERE value IS NULL"


NB = [*cells_sql(), *neighbours_sql()]
EDGES = f"coalesce({LINE}, pval, nval)"


@query(fill_sql(EDGES, *NB))
def impute_linear(spark: SparkSession, sf: str) -> DataFrame:
    return holes(temporal.linear(cells(spark, sf)))


LIMIT = f"CASE WHEN least(pos - ppos, npos - pos) <= 14 THEN {EDGES} END"


@query(fill_sql(LIMIT, *NB))
def impute_linear_limit(spark: SparkSession, sf: str) -> DataFrame:
    return holes(temporal.linear(cells(spark, sf), limit=14))


# The irregular panel: observed days only, with the odd ones blanked, so that rows and
# days differ.
IRREGULAR = [*panel_sql("nation"), """irr AS (SELECT location, obs_date, 'total' AS variable, CASE WHEN day(obs_date) % 3 <> 0 THEN total END AS value FROM panel)"""]


def _irregular(spark: SparkSession, sf: str) -> DataFrame:
    p = T.orders_panel(spark, sf, "nation")
    return p.select(
        "location", "obs_date", F.lit("total").alias("variable"),
        F.when(F.dayofmonth("obs_date") % 3 != 0, F.col("total")).alias("value"),
    )


@query(fill_sql(f"coalesce({LINE_DAY}, pval, nval)", *IRREGULAR, *neighbours_sql("irr")))
def impute_time(spark: SparkSession, sf: str) -> DataFrame:
    return holes(temporal.linear(_irregular(spark, sf), axis="day"))


@query(fill_sql(f"coalesce({LINE_DAY}, pval)", *IRREGULAR, *neighbours_sql("irr")))
def sparse_to_daily(spark: SparkSession, sf: str) -> DataFrame:
    return holes(temporal.linear(_irregular(spark, sf), axis="day", edges="trailing"))


def parabola_sql(axis: str = "row") -> str:
    def d(newer: str, older: str) -> str:
        if axis == "row":
            return f"({newer}pos - {older}pos)"
        col = lambda x: f"{x}date" if x else "obs_date"
        return f"date_diff('day', {col(older)}, {col(newer)})"

    def through(a: str, b: str, c: str) -> str:
        xa, xb, xc = d("", a), d("", b), d("", c)
        ab, ac, bc = d(a, b), d(a, c), d(b, c)
        return (
            f"({a}val * ({xb} * {xc}) / ({ab} * {ac}) - {b}val * ({xa} * {xc}) / ({ab} * {bc}) "
            f"+ {c}val * ({xa} * {xb}) / ({ac} * {bc}))"
        )

    return (
        f"CASE WHEN ppos IS NOT NULL AND npos IS NOT NULL AND pbpos >= 0 THEN {through('pb', 'p', 'n')} "
        f"WHEN ppos IS NOT NULL AND npos IS NOT NULL AND napos >= 0 THEN {through('p', 'n', 'na')} END"
    )


@query(fill_sql(f"coalesce({parabola_sql()}, {LINE})", *NB, digits=3))
def impute_quadratic_local(spark: SparkSession, sf: str) -> DataFrame:
    return holes(temporal.quadratic(cells(spark, sf)), 3)


def spline_sql(src: str = "nb_p", x: str = "pos") -> list[str]:
    """Pieces of the quadratic spline: one tridiagonal system a series, eliminated point by point."""
    k = "location, variable"
    on = lambda a, b, shift: f"{a}.location = {b}.location AND {a}.variable = {b}.variable AND {a}.p = {b}.p {shift}"
    return [
        f"""pt0 AS (SELECT {k}, {x} AS x, value AS y, row_number() OVER w - 1 AS p, count(*) OVER (PARTITION BY {k}) AS n, first_value({x}) OVER w AS xa,
    last_value({x}) OVER (PARTITION BY {k} ORDER BY obs_date ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS xe,
    lag({x}, 2) OVER w AS b2, lag({x}) OVER w AS b1, lead({x}) OVER w AS a1, lead({x}, 2) OVER w AS a2
  FROM {src} WHERE value IS NOT NULL WINDOW w AS (PARTITION BY {k} ORDER BY obs_date))""",
        """pt1 AS (SELECT *, CASE WHEN p <= 2 THEN xa ELSE (b2 + b1) / 2.0::DOUBLE END AS k0, CASE WHEN p <= 1 THEN xa WHEN p >= n - 1 THEN xe ELSE (b1 + x) / 2.0::DOUBLE END AS k1,
    CASE WHEN p <= 0 THEN xa WHEN p >= n - 2 THEN xe ELSE (x + a1) / 2.0::DOUBLE END AS k2, CASE WHEN p >= n - 3 THEN xe ELSE (a1 + a2) / 2.0::DOUBLE END AS k3 FROM pt0 WHERE n > 2)""",
        """pt2 AS (SELECT *, CASE WHEN p > 0 AND p < n - 1 THEN (k2 - x) * (k2 - x) / ((k2 - k1) * (k2 - k0)) ELSE 0 END AS l,
    CASE WHEN p > 0 AND p < n - 1 THEN (x - k1) * (x - k1) / ((k2 - k1) * (k3 - k1)) ELSE 0 END AS r FROM pt1)""",
        f"""fw AS (SELECT {k}, p, 0::DOUBLE AS ratio, y::DOUBLE AS d FROM pt2 WHERE p = 0
  UNION ALL SELECT t.location, t.variable, t.p, t.r / (1 - t.l - t.r - t.l * f.ratio), (t.y - t.l * f.d) / (1 - t.l - t.r - t.l * f.ratio) FROM fw f JOIN pt2 t ON {on('t', 'f', '+ 1')})""",
        f"fwp AS MATERIALIZED (SELECT f.*, t.n FROM fw f JOIN pt2 t ON {on('t', 'f', '')})",
        f"""bw AS (SELECT {k}, p, d AS c FROM fwp WHERE p = n - 1
  UNION ALL SELECT f.location, f.variable, f.p, f.d - f.ratio * b.c FROM bw b JOIN fwp f ON {on('f', 'b', '- 1')})""",
        f"co AS (SELECT *, lag(c) OVER w AS cl, lead(c) OVER w AS cr FROM bw WINDOW w AS (PARTITION BY {k} ORDER BY p))",
        f"""piece0 AS (SELECT t.*, 2 * (co.c - co.cl) / (k2 - k0) AS s1, 2 * (co.cr - co.c) / (k3 - k1) AS s2 FROM pt2 t JOIN co ON {on('t', 'co', '')} WHERE t.p > 0 AND t.p < t.n - 1)""",
        "piece AS (SELECT location, variable, x, y, k2 AS until, (s2 - s1) / (2 * (k2 - k1)) AS bend, s1 + (s2 - s1) / (k2 - k1) * (x - k1) AS slope FROM piece0)",
    ]


def along_sql(t: str, x: str = "nb.pos") -> str:
    return f"({t}.y + {t}.slope * ({x} - {t}.x) + {t}.bend * ({x} - {t}.x) * ({x} - {t}.x))"


@query(with_(*NB, *spline_sql()).replace("WITH ", "WITH RECURSIVE ", 1) + f"""SELECT nb.location, nb.variable, nb.obs_date,
  {R(f"CASE WHEN ppos IS NOT NULL AND npos IS NOT NULL THEN coalesce(CASE WHEN nb.pos <= lp.until THEN {along_sql('lp')} ELSE {along_sql('rp')} END, {LINE}) END", 3)} AS filled
FROM nb LEFT JOIN piece lp ON lp.location = nb.location AND lp.variable = nb.variable AND lp.x = ppos
LEFT JOIN piece rp ON rp.location = nb.location AND rp.variable = nb.variable AND rp.x = npos WHERE nb.value IS NULL""")
def impute_quadratic(spark: SparkSession, sf: str) -> DataFrame:
    return holes(spline.quadratic_spline(cells(spark, sf)), 3)


@query(with_(*cells_sql()) + f"""SELECT location, variable, obs_date, {R('m')} AS filled FROM (
  SELECT *, avg(value) OVER (PARTITION BY location, variable, dayofyear(obs_date)) AS m FROM cells) WHERE value IS NULL""")
def impute_climatology_doy(spark: SparkSession, sf: str) -> DataFrame:
    return holes(temporal.climatology_doy(cells(spark, sf)))


@query(with_(*cells_sql()) + f"""SELECT location, variable, obs_date, {R('m')} AS filled FROM (
  SELECT *, avg(value) OVER (PARTITION BY variable, dayofyear(obs_date)) AS m FROM cells) WHERE value IS NULL""")
def impute_climatology_pooled(spark: SparkSession, sf: str) -> DataFrame:
    return holes(temporal.climatology_doy(cells(spark, sf), pool_locations=True))


@query(with_(*cells_sql()) + f"""SELECT location, variable, obs_date, {R('m')} AS filled FROM (
  SELECT *, avg(value) OVER (PARTITION BY location, variable, month(obs_date), day(obs_date)) AS m FROM cells) WHERE value IS NULL""")
def impute_climatology_md(spark: SparkSession, sf: str) -> DataFrame:
    return holes(temporal.climatology_month_day(cells(spark, sf)))


@query(with_(
    *NB, f"p1 AS (SELECT *, coalesce(value, {LIMIT}) AS v1 FROM nb)",
    "p2 AS (SELECT *, coalesce(v1, avg(v1) OVER (PARTITION BY location, variable, month(obs_date))) AS v2 FROM p1)",
    "p3 AS (SELECT *, coalesce(v2, avg(v2) OVER (PARTITION BY location, variable)) AS v3 FROM p2)",
    "p4 AS (SELECT *, coalesce(v3, avg(v3) OVER (PARTITION BY variable)) AS v4 FROM p3)",
) + f"SELECT location, variable, obs_date, {R('v4')} AS filled FROM p4 WHERE value IS NULL")
def impute_three_phase(spark: SparkSession, sf: str) -> DataFrame:
    return holes(temporal.three_phase(cells(spark, sf)))


@query(with_(
    *cells_sql(), "train AS (SELECT * FROM cells WHERE obs_date <= DATE '1999-12-31')", "test AS (SELECT * FROM cells WHERE obs_date > DATE '1999-12-31')",
    "m AS (SELECT location, variable, month(obs_date) AS mo, avg(value) AS v FROM train GROUP BY 1, 2, 3)",
    "l AS (SELECT location, variable, avg(value) AS v FROM train GROUP BY 1, 2)", "g AS (SELECT variable, avg(value) AS v FROM train GROUP BY 1)",
) + f"""SELECT t.location, t.variable, t.obs_date, {R('coalesce(m.v, l.v, g.v)')} AS filled FROM test t
  LEFT JOIN m ON m.location = t.location AND m.variable = t.variable AND m.mo = month(t.obs_date)
  LEFT JOIN l ON l.location = t.location AND l.variable = t.variable LEFT JOIN g ON g.variable = t.variable WHERE t.value IS NULL""")
def impute_fit_transform(spark: SparkSession, sf: str) -> DataFrame:
    c = cells(spark, sf)
    cut = F.lit("1999-12-31").cast("date")
    return holes(temporal.MeanImputer.fit(c.filter(F.col("obs_date") <= cut)).transform(c.filter(F.col("obs_date") > cut)))


ADAPTIVE = f"""CASE WHEN {GAP} < 7 THEN {LINE_DAY} WHEN {GAP} <= 30 THEN coalesce({parabola_sql('day')}, {LINE_DAY}) ELSE md END"""


@query(with_(
    *NB, "md AS (SELECT *, avg(value) OVER (PARTITION BY location, variable, month(obs_date), day(obs_date)) AS md FROM nb)",
    f"a AS (SELECT location, variable, obs_date, value, coalesce(value, {ADAPTIVE}) AS v1 FROM md)",
    """b AS (SELECT *, coalesce(v1, last_value(v1 IGNORE NULLS) OVER (PARTITION BY location, variable ORDER BY obs_date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  first_value(v1 IGNORE NULLS) OVER (PARTITION BY location, variable ORDER BY obs_date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS v2 FROM a)""",
) + f"SELECT location, variable, obs_date, {R('v2', 3)} AS filled FROM b WHERE value IS NULL")
def impute_gap_adaptive(spark: SparkSession, sf: str) -> DataFrame:
    return holes(temporal.gap_adaptive(cells(spark, sf)), 3)


@query(fill_sql("coalesce(pval, nval)", *NB))
def impute_ffill_bfill(spark: SparkSession, sf: str) -> DataFrame:
    return holes(temporal.ffill_bfill(cells(spark, sf)))


@query(with_(*cells_sql(), "m AS (SELECT variable, quantile_cont(value, 0.5) AS v FROM cells GROUP BY 1)")
+ f"SELECT location, variable, obs_date, {R('m.v')} AS filled FROM cells JOIN m USING (variable) WHERE value IS NULL")
def impute_median(spark: SparkSession, sf: str) -> DataFrame:
    return holes(temporal.median_fill(cells(spark, sf)))


# Run date of the live queries: two days after the last order.
RUN = "(SELECT CAST(max(o_orderdate) AS DATE) + 2 FROM orders)"


def run_date(spark: SparkSession, sf: str) -> Column:
    return F.date_add(order_days(spark, sf)[1], 2)


NOWCAST = [
    f"""recent AS (SELECT *, min(obs_date) OVER (PARTITION BY location, variable) AS x0 FROM (
    SELECT *, row_number() OVER (PARTITION BY location, variable ORDER BY obs_date DESC) AS rk FROM hist WHERE value IS NOT NULL AND obs_date <= {RUN}) WHERE rk <= 5)""",
    f"""fit AS (SELECT location, variable, max(obs_date) AS last_date, arg_max(value, obs_date) AS last_value, count(*) AS n, max(x0) AS x0,
    regr_slope(value, date_diff('day', x0, obs_date)) AS slope, regr_intercept(value, date_diff('day', x0, obs_date)) AS icpt,
    min(value) AS lo, max(value) AS hi FROM recent GROUP BY 1, 2)""",
    f"""now_ AS (SELECT location, variable, last_date, last_value, date_diff('day', last_date, {RUN}) AS gap_days,
    CASE WHEN date_diff('day', last_date, {RUN}) > 14 THEN NULL WHEN date_diff('day', last_date, {RUN}) <= 2 OR n < 2 THEN last_value
      ELSE least(greatest(icpt + slope * date_diff('day', x0, {RUN}), lo - 0.25::DOUBLE * greatest(hi - lo, 1e-6)), hi + 0.25::DOUBLE * greatest(hi - lo, 1e-6)) END AS nowcast FROM fit)""",
]
HIST = [*panel_sql("nation"), unpivot_sql("panel", VARS, "hist")]


def _history(spark: SparkSession, sf: str) -> DataFrame:
    return to_cells(T.orders_panel(spark, sf, "nation"), VARS)


@query(with_(*HIST, *NOWCAST) + f"SELECT location, variable, last_date, CAST(gap_days AS INTEGER) AS gap_days, {R('nowcast', 3)} AS nowcast FROM now_")
def nowcast_short_gap(spark: SparkSession, sf: str) -> DataFrame:
    return rr(temporal.nowcast(_history(spark, sf), run_date(spark, sf)).drop("last_value"), "nowcast", digits=3)


@query(with_(
    *HIST, *NOWCAST, "lm AS (SELECT location, variable, month(obs_date) AS mo, avg(value) AS v FROM hist GROUP BY 1, 2, 3)",
    "lo_ AS (SELECT location, variable, avg(value) AS v FROM hist GROUP BY 1, 2)", "gl AS (SELECT variable, avg(value) AS v FROM hist GROUP BY 1)",
    f"""j AS (SELECT lo_.location, lo_.variable, CASE WHEN gap_days = 0 THEN last_value END AS obs, nowcast, lm.v AS lmv, lo_.v AS lv, gl.v AS gv FROM lo_
  LEFT JOIN now_ ON now_.location = lo_.location AND now_.variable = lo_.variable
  LEFT JOIN lm ON lm.location = lo_.location AND lm.variable = lo_.variable AND lm.mo = month({RUN}) JOIN gl ON gl.variable = lo_.variable)""",
) + f"""SELECT location, variable, {RUN} AS obs_date, {R('coalesce(obs, nowcast, lmv, lv, gv)', 3)} AS value,
  CASE WHEN obs IS NOT NULL THEN 'observed' WHEN nowcast IS NOT NULL THEN 'temporal_short_gap' WHEN lmv IS NOT NULL THEN 'climatological_location_month'
    WHEN lv IS NOT NULL THEN 'climatological_location' ELSE 'climatological_global' END AS source FROM j""")
def fallback_provenance(spark: SparkSession, sf: str) -> DataFrame:
    return rr(temporal.with_fallbacks(_history(spark, sf), run_date(spark, sf)), "value", digits=3)


@query(with_(*panel_sql("nation"), """recent AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY location ORDER BY obs_date DESC) AS rk FROM panel) WHERE rk <= 30)""")
+ f"""SELECT location, CAST(30 AS INTEGER) AS steps, CAST(30 - count(*) AS INTEGER) AS padded, min(obs_date) AS first_day, max(obs_date) AS last_day, {R('arg_min(total, obs_date)')} AS first_total,
  {R('(sum(total) + (30 - count(*)) * arg_min(total, obs_date)) / 30')} AS mean_total FROM recent GROUP BY location""")
def sequence_padded(spark: SparkSession, sf: str) -> DataFrame:
    seq = features.padded_sequence(T.orders_panel(spark, sf, "nation").select("location", "obs_date", "total"), ["total"])
    s = F.col("sequence")
    total = F.aggregate(F.transform(s, lambda x: x["total"]), F.lit(0.0), lambda a, x: a + x)
    return seq.select(
        "location", F.size(s).alias("steps"), (F.lit(30) - F.size(F.array_distinct(s))).alias("padded"),
        s[0]["obs_date"].alias("first_day"), F.element_at(s, -1)["obs_date"].alias("last_day"),
        r(s[0]["total"]).alias("first_total"), r(total / 30).alias("mean_total"),
    )


# --- spatial -------------------------------------------------------------------

PAIRS = [*cells_sql("nation"), donors_sql("nation"), pairs_sql()]


def _pairs(spark: SparkSession, sf: str, per_target: int = 1) -> DataFrame:
    return with_donor(cells(spark, sf, "nation"), T.donors(spark, sf, "nation", per_target))


@query(with_(*cells_sql("nation"), donors_sql("nation", 3), pairs_sql()) + f"""SELECT location, variable, obs_date,
  {R('sum(donor_value / distance_km) / nullif(sum(CASE WHEN donor_value IS NOT NULL THEN 1 / distance_km END), 0)')} AS filled
FROM pairs WHERE value IS NULL GROUP BY location, variable, obs_date""")
def impute_idw(spark: SparkSession, sf: str) -> DataFrame:
    return holes(spatial.idw(_pairs(spark, sf, 3)))


KRIGE = """krige AS (SELECT location, donor, variable, count(*) AS n, avg(value) AS mt, avg(donor_value) AS md,
    CASE WHEN var_pop(donor_value) > 0 THEN covar_samp(value, donor_value) / var_pop(donor_value) ELSE 0 END AS w
  FROM pairs WHERE value IS NOT NULL AND donor_value IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) >= 20)"""
KRIGE_EST = "k.mt + k.w * (p.donor_value - k.md)"
ON_PAIR = "k.location = p.location AND k.donor = p.donor AND k.variable = p.variable"


@query(with_(*PAIRS, KRIGE) + f"SELECT p.location, p.variable, p.obs_date, {R(KRIGE_EST)} AS filled FROM pairs p LEFT JOIN krige k ON {ON_PAIR} WHERE p.value IS NULL")
def impute_kriging(spark: SparkSession, sf: str) -> DataFrame:
    return holes(spatial.kriging(_pairs(spark, sf)))


REGR1 = """regr AS (SELECT location, donor, variable, regr_slope(value, donor_value) AS b, regr_intercept(value, donor_value) AS a
  FROM pairs WHERE value IS NOT NULL AND donor_value IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) >= 10)"""


@query(with_(*PAIRS, REGR1) + f"SELECT p.location, p.variable, p.obs_date, {R('k.a + k.b * p.donor_value')} AS filled FROM pairs p LEFT JOIN regr k ON {ON_PAIR} WHERE p.value IS NULL")
def impute_xloc_regr1(spark: SparkSession, sf: str) -> DataFrame:
    return holes(spatial.regression1(_pairs(spark, sf)))


# Three predictors need days with the donor present today, yesterday and a week ago;
# the region panel is dense enough for that.
LAGGED = [
    *cells_sql("region"), donors_sql("region"),
    "lagged AS (SELECT *, lag(value, 1) OVER w AS l1, lag(value, 7) OVER w AS l7 FROM cells WINDOW w AS (PARTITION BY location, variable ORDER BY obs_date))",
    """pairs AS (SELECT c.*, x.donor, d.value AS x0, d.l1 AS x1, d.l7 AS x2 FROM cells c JOIN donors x ON x.target = c.location
  LEFT JOIN lagged d ON d.location = x.donor AND d.variable = c.variable AND d.obs_date = c.obs_date)""",
    """ok AS (SELECT * FROM pairs WHERE value IS NOT NULL AND x0 IS NOT NULL AND x1 IS NOT NULL AND x2 IS NOT NULL)""",
    """mom AS (SELECT location, donor, variable, avg(value) AS my, avg(x0) AS m0, avg(x1) AS m1, avg(x2) AS m2,
    covar_pop(x0, value) AS y0, covar_pop(x1, value) AS y1, covar_pop(x2, value) AS y2, covar_pop(x0, x0) AS c00, covar_pop(x0, x1) AS c01,
    covar_pop(x0, x2) AS c02, covar_pop(x1, x1) AS c11, covar_pop(x1, x2) AS c12, covar_pop(x2, x2) AS c22 FROM ok GROUP BY 1, 2, 3 HAVING count(*) >= 10)""",
]


def _det(m: list[list[str]]) -> str:
    (a, b, c), (d, e, f), (g, h, i) = m
    return f"({a} * ({e} * {i} - {f} * {h}) - {b} * ({d} * {i} - {f} * {g}) + {c} * ({d} * {h} - {e} * {g}))"


_C = [["c00", "c01", "c02"], ["c01", "c11", "c12"], ["c02", "c12", "c22"]]
_BETA = [
    f"{_det([[f'y{i}' if j == k else _C[i][j] for j in range(3)] for i in range(3)])} / nullif({_det(_C)}, 0) AS b{k}" for k in range(3)
]
COEF_OF = f"coef AS (SELECT {{keys}}, my, m0, m1, m2, {', '.join(_BETA)} FROM mom)"
COEF = COEF_OF.format(keys="location, donor, variable")
REGR3 = "k.my + k.b0 * (p.x0 - k.m0) + k.b1 * (p.x1 - k.m1) + k.b2 * (p.x2 - k.m2)"


@query(with_(*LAGGED, COEF) + f"SELECT p.location, p.variable, p.obs_date, {R(REGR3, 3)} AS filled FROM pairs p LEFT JOIN coef k ON {ON_PAIR} WHERE p.value IS NULL")
def impute_xloc_regression(spark: SparkSession, sf: str) -> DataFrame:
    pairs = spatial.with_donor_lags(cells(spark, sf, "region"), T.donors(spark, sf, "region"), (1, 7))
    return holes(spatial.regression3(pairs), 3)


LAGS = [
    *cells_sql("region"), donors_sql("region"),
    "tries AS (SELECT target, donor, lag FROM donors, (SELECT unnest(generate_series(0, 7))::INTEGER AS lag))",
    """per_lag AS (SELECT x.target AS location, x.donor, t.variable, x.lag, covar_pop(t.value, d.value) / nullif(sqrt(var_pop(t.value) * var_pop(d.value)), 0) AS r
  FROM (SELECT * FROM cells WHERE value IS NOT NULL) t JOIN tries x ON x.target = t.location
  JOIN (SELECT * FROM cells WHERE value IS NOT NULL) d ON d.location = x.donor AND d.variable = t.variable AND d.obs_date = t.obs_date - x.lag GROUP BY 1, 2, 3, 4 HAVING count(*) > 20)""",
    "best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY location, donor, variable ORDER BY round(r, 12) DESC, lag) AS rk FROM per_lag WHERE r > -1) WHERE rk = 1)",
]


@query(with_(*LAGS) + f"SELECT location, donor, variable, lag, {R('r')} AS r FROM best")
def best_lag_corr(spark: SparkSession, sf: str) -> DataFrame:
    return rr(spatial.best_lag(cells(spark, sf, "region"), T.donors(spark, sf, "region")), "r")


MOVED = "moved AS (SELECT b.location, b.variable, d.obs_date + b.lag AS obs_date, arg_min(d.value, (-round(b.r, 12), b.donor)) AS v FROM best b JOIN cells d ON d.location = b.donor AND d.variable = b.variable WHERE d.value IS NOT NULL GROUP BY 1, 2, 3)"
ADVECTED = f"SELECT c.location, c.variable, c.obs_date, {R('m.v')} AS filled FROM cells c LEFT JOIN moved m ON m.location = c.location AND m.variable = c.variable AND m.obs_date = c.obs_date WHERE c.value IS NULL"


@query(with_(*LAGS, MOVED) + ADVECTED)
def impute_advection(spark: SparkSession, sf: str) -> DataFrame:
    return holes(spatial.advection(cells(spark, sf, "region"), T.donors(spark, sf, "region")))


# Similar days: the target misses the days of the month divisible by four.
KNN = [
    *spined_sql("region"), donors_sql("region"),
    "holed AS (SELECT location, obs_date, balance, n_orders, CASE WHEN day(obs_date) % 4 <> 0 THEN total END AS total FROM spined)",
    """q AS (SELECT h.location, h.obs_date, x.donor, d.balance, d.n_orders FROM holed h JOIN donors x ON x.target = h.location
  JOIN holed d ON d.location = x.donor AND d.obs_date = h.obs_date WHERE h.total IS NULL AND d.balance IS NOT NULL AND d.n_orders IS NOT NULL)""",
    """dist AS (SELECT q.location, q.obs_date, t.obs_date AS tday, t.total AS y,
    sqrt((q.balance - t.balance) * (q.balance - t.balance) + (q.n_orders - t.n_orders) * (q.n_orders - t.n_orders)) / pow(0.95::DOUBLE, abs(date_diff('day', q.obs_date, t.obs_date))) AS d
  FROM q JOIN spined t ON t.location = q.donor WHERE t.total IS NOT NULL AND t.balance IS NOT NULL AND t.n_orders IS NOT NULL)""",
    "near AS (SELECT * FROM dist QUALIFY row_number() OVER (PARTITION BY location, obs_date ORDER BY d, tday) <= 5)",
    "est AS (SELECT location, obs_date, sum(y / (d + 1e-10)) / sum(1 / (d + 1e-10)) AS e FROM near GROUP BY 1, 2)",
]


def _holed(spark: SparkSession, sf: str) -> DataFrame:
    s = spined(spark, sf, "region")
    return s.withColumn("total", F.when(F.dayofmonth("obs_date") % 4 != 0, F.col("total")))


@query(with_(*KNN) + f"SELECT h.location, h.obs_date, {R('est.e', 3)} AS filled FROM holed h LEFT JOIN est USING (location, obs_date) WHERE h.total IS NULL")
def impute_knn(spark: SparkSession, sf: str) -> DataFrame:
    out = spatial.knn(
        _holed(spark, sf), T.donors(spark, sf, "region"), "total", ["balance", "n_orders"], train=spined(spark, sf, "region").dropna()
    )
    return out.filter(F.col("value").isNull()).select("location", "obs_date", r("filled", 3).alias("filled"))


@query()
def impute_eof_pca(spark: SparkSession, sf: str) -> DataFrame:
    """All regions and variables; a third of the days of one series are blanked, filled from
    the leading modes, and shown beside the truth."""
    truth = cells(spark, sf, "region")
    hidden = (F.col("location") == "ASIA") & (F.col("variable") == "total") & (F.dayofmonth("obs_date") % 3 == 0)
    blank = truth.withColumn("truth", F.col("value")).withColumn("value", F.when(~hidden, F.col("value")))
    out = modes.eof_fill(blank).filter((F.col("location") == "ASIA") & (F.col("variable") == "total") & F.col("value").isNull())
    return out.select("obs_date", r("truth").alias("truth"), r("filled").alias("filled"))


def elimination_sql(features: Sequence[str], target: str, src: str) -> list[str]:
    """``beta`` (i, b, m) and ``goal`` (my): least squares over the rows of ``src``, solved one predictor a step."""
    k = len(features)
    names = [*features, target]
    cells_ = "\n  UNION ALL ".join(f"SELECT {i} AS i, {j} AS j, covar_pop({names[i]}, {names[j]}) AS v FROM {src}" for i in range(k) for j in range(k + 1))
    steps = [
        f"""e{p + 1} AS (SELECT a.i, a.j, CASE WHEN a.i = {p} THEN a.v / pp.v ELSE a.v - ip.v / pp.v * pj.v END AS v FROM e{p} a
  JOIN e{p} pp ON pp.i = {p} AND pp.j = {p} JOIN e{p} ip ON ip.i = a.i AND ip.j = {p} JOIN e{p} pj ON pj.i = {p} AND pj.j = a.j)""" for p in range(k)
    ]
    line = " + ".join(f"(SELECT v FROM e{k} WHERE i = {i} AND j = {k}) * ({c} - (SELECT avg({c}) FROM {src}))" for i, c in enumerate(features))
    return [f"e0 AS ({cells_})", *steps, f"guess AS (SELECT *, (SELECT avg({target}) FROM {src}) + {line} AS e FROM rows_)"]


CALENDAR = ["balance", "n_orders", "doy", "mon"]


@query(with_(
    *spined_sql("region"), "rows_ AS (SELECT location, obs_date, CASE WHEN day(obs_date) % 4 <> 0 THEN total END AS total, balance, n_orders, dayofyear(obs_date)::DOUBLE AS doy, month(obs_date)::DOUBLE AS mon FROM spined)",
    "known AS (SELECT * FROM rows_ WHERE total IS NOT NULL AND balance IS NOT NULL AND n_orders IS NOT NULL)", *elimination_sql(CALENDAR, "total", "known"),
) + f"SELECT location, obs_date, {R('e', 2)} AS filled FROM guess WHERE total IS NULL")
def calendar_regression_impute(spark: SparkSession, sf: str) -> DataFrame:
    """Total from balance, count and calendar position by least squares on the region panel."""
    df = _holed(spark, sf).withColumn("doy", F.dayofyear("obs_date").cast("double")).withColumn("mon", F.month("obs_date").cast("double"))
    out = spatial.gradient_regression(df, "total", CALENDAR)
    return out.filter(F.col("total").isNull()).select("location", "obs_date", r("filled", 2).alias("filled"))


GRID = """grid AS (SELECT (l_partkey % 100) / 10.0::DOUBLE AS lat, (l_suppkey % 100) / 10.0::DOUBLE AS lon, CAST(l_linenumber AS DOUBLE) AS depth, CAST(l_shipdate AS DATE) AS obs_date,
  CASE WHEN l_linenumber <> 7 THEN l_quantity END AS u FROM lineitem)"""
BOXES = """boxes AS (SELECT r_name AS site, r_regionkey * 2.0::DOUBLE AS lon_min, r_regionkey * 2.0::DOUBLE + 1.5 AS lon_max, r_regionkey * 1.5::DOUBLE AS lat_min, r_regionkey * 1.5::DOUBLE + 2.0 AS lat_max FROM region)"""
SITES = [
    GRID, BOXES, "mid AS (SELECT site, (lon_min + lon_max) / 2 AS lon, (lat_min + lat_max) / 2 AS lat FROM boxes)",
    "shore AS (SELECT DISTINCT lon, lat FROM grid WHERE u IS NULL)",
    f"""km AS (SELECT m.site, min(2 * {coast.EARTH_KM} * asin(sqrt(least(1.0, pow(sin(radians(s.lat - m.lat) / 2), 2) + cos(radians(m.lat)) * cos(radians(s.lat)) * pow(sin(radians(s.lon - m.lon) / 2), 2))))) AS distance_km
  FROM mid m, shore s GROUP BY 1)""",
    "deep AS (SELECT lat, lon, max(depth) AS depth FROM grid WHERE u IS NOT NULL GROUP BY 1, 2)",
    "dp AS (SELECT site, -avg(depth) AS depth_m FROM boxes JOIN deep ON lat BETWEEN lat_min AND lat_max AND lon BETWEEN lon_min AND lon_max GROUP BY 1)",
    "attrs AS (SELECT mid.*, distance_km, depth_m FROM mid LEFT JOIN km USING (site) LEFT JOIN dp USING (site))",
]


def _attributes(spark: SparkSession, sf: str) -> DataFrame:
    grid = T.grid_cells(spark, sf)
    return coast.site_attributes(T.sites(spark, sf), grid.filter(F.col("u").isNull()).select("lon", "lat"), grid.filter(F.col("u").isNotNull()))


@query(with_(*SITES) + f"SELECT site, {R('lon')} AS lon, {R('lat')} AS lat, {R('distance_km')} AS distance_km, {R('depth_m')} AS depth_m FROM attrs")
def site_attributes(spark: SparkSession, sf: str) -> DataFrame:
    """Middle, distance to the nearest land point of the grid, and mean depth of every site."""
    return rr(_attributes(spark, sf), "lon", "lat", "distance_km", "depth_m")


def _halves(across: str, along: str) -> str:
    w = f"(PARTITION BY site, period, {across} ORDER BY {along})"
    return f"""CASE WHEN lag(1) OVER {w} IS NULL AND lead(1) OVER {w} IS NULL THEN NULL WHEN lag(1) OVER {w} IS NULL THEN lead(v) OVER {w} - v
    WHEN lead(1) OVER {w} IS NULL THEN v - lag(v) OVER {w} ELSE (lead(v) OVER {w} - lag(v) OVER {w}) / 2 END"""


AROUND = [
    "inside AS (SELECT site, CAST(date_trunc('month', obs_date) AS DATE) AS period, g.lat, g.lon, u FROM grid g JOIN boxes ON lat BETWEEN lat_min AND lat_max AND lon BETWEEN lon_min AND lon_max WHERE u IS NOT NULL)",
    "sq AS (SELECT site, period, floor(lat / 0.5) AS lat, floor(lon / 0.5) AS lon, avg(u) AS v FROM inside GROUP BY ALL)",
    f"gr AS (SELECT site, period, sqrt(avg(gx) * avg(gx) + avg(gy) * avg(gy)) AS gradient FROM (SELECT site, period, {_halves('lat', 'lon')} AS gx, {_halves('lon', 'lat')} AS gy FROM sq) GROUP BY 1, 2)",
    "around_ AS (SELECT * FROM gr JOIN (SELECT site, period, var_pop(u) AS variance FROM inside GROUP BY 1, 2) USING (site, period))",
]


@query(with_(
    *spined_sql("region"), *SITES, *AROUND,
    """rows_ AS (SELECT s.location, s.obs_date, CASE WHEN day(s.obs_date) % 4 <> 0 THEN s.total END AS total, gradient, variance, distance_km, depth_m FROM spined s
  LEFT JOIN around_ a ON a.site = s.location AND a.period = CAST(date_trunc('month', s.obs_date) AS DATE) LEFT JOIN attrs t ON t.site = s.location)""",
    "known AS (SELECT * FROM rows_ WHERE total IS NOT NULL AND gradient IS NOT NULL AND variance IS NOT NULL AND distance_km IS NOT NULL AND depth_m IS NOT NULL)",
    *elimination_sql(coast.CONTEXT, "total", "known"),
) + f"SELECT location, obs_date, {R('e', 2)} AS filled FROM guess WHERE total IS NULL")
def gradient_regression_impute(spark: SparkSession, sf: str) -> DataFrame:
    """Total of a region from what surrounds its site: gradient and variance of the gridded field, distance to land, depth."""
    near = coast.spatial_context(T.grid_cells(spark, sf), zonal.site_boxes(T.sites(spark, sf)), "u", F.trunc("obs_date", "month"))
    facts = _attributes(spark, sf).drop("lon", "lat").withColumnRenamed("site", "location")
    rows = _holed(spark, sf).withColumn("period", F.trunc("obs_date", "month")).join(near.withColumnRenamed("site", "location"), ["location", "period"], "left")
    out = spatial.gradient_regression(rows.join(facts, "location", "left"), "total", coast.CONTEXT)
    return out.filter(F.col("total").isNull()).select("location", "obs_date", r("filled", 2).alias("filled"))


# --- any number of donors -------------------------------------------------------

def joint_sql(lags: int, min_rows: int, scaled: bool = False, donors: int = 3, source: str = "cells") -> list[str]:
    """``est``: the estimate from all donors of every cell where each of them has every value.

    Predictors are rows (cell, i, x), the target has the last i; the equations are solved by
    elimination, one step a table.
    """
    k, cell = donors * lags, "location, variable, obs_date"
    slots = ("value", "l1", "l7")[:lags]
    each = "\n  UNION ALL ".join(f"SELECT c.location, c.variable, c.obs_date, x.rank * {lags} + {n} AS i, d.{slot} AS x FROM {source} c JOIN rk x ON x.target = c.location JOIN lagged d ON d.location = x.donor AND d.variable = c.variable AND d.obs_date = c.obs_date" for n, slot in enumerate(slots))
    steps = []
    for p in range(k):
        steps.append(f"""g{p + 1} AS (SELECT a.location, a.variable, a.i, a.j, CASE WHEN a.i = {p} THEN a.v / pp.v ELSE a.v - ip.v / pp.v * pj.v END AS v FROM g{p} a
  JOIN g{p} pp ON pp.location = a.location AND pp.variable = a.variable AND pp.i = {p} AND pp.j = {p}
  JOIN g{p} ip ON ip.location = a.location AND ip.variable = a.variable AND ip.i = a.i AND ip.j = {p}
  JOIN g{p} pj ON pj.location = a.location AND pj.variable = a.variable AND pj.i = {p} AND pj.j = a.j)""")
    return [
        "rk AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY distance_km, donor) - 1 AS rank FROM donors)",
        "lagged AS (SELECT location, variable, obs_date, value, lag(value, 1) OVER w AS l1, lag(value, 7) OVER w AS l7 FROM cells WINDOW w AS (PARTITION BY location, variable ORDER BY obs_date))",
        f"pl AS ({each})",
        f"full_ AS (SELECT {cell} FROM pl GROUP BY {cell} HAVING count(x) = {k})",
        f"px AS (SELECT pl.* FROM pl JOIN full_ USING ({cell}))",
        f"z AS (SELECT px.* FROM px JOIN {source} c USING ({cell}) WHERE c.value IS NOT NULL UNION ALL SELECT {cell}, {k}, c.value FROM {source} c JOIN full_ USING ({cell}) WHERE c.value IS NOT NULL)",
        f"""mom2 AS (SELECT a.location, a.variable, a.i, b.i AS j, count(*) AS n, avg(a.x) AS m, covar_pop(a.x, b.x) AS c FROM z a JOIN z b USING ({cell}) GROUP BY ALL HAVING count(*) >= {min_rows})""",
        f"g0 AS (SELECT location, variable, i, j, c AS v FROM mom2 WHERE i < {k})", *steps,
        f"""model AS (SELECT g.location, g.variable, g.i, g.v{' * m.n / (m.n - 1)' if scaled else ''} AS b, m.m, y.m AS my FROM g{k} g JOIN mom2 m ON m.location = g.location AND m.variable = g.variable AND m.i = g.i AND m.j = g.i
  JOIN mom2 y ON y.location = g.location AND y.variable = g.variable AND y.i = {k} AND y.j = {k} WHERE g.j = {k})""",
        f"est AS (SELECT px.location, px.variable, px.obs_date, any_value(my) + sum(b * (x - m)) AS e FROM px JOIN model USING (location, variable, i) GROUP BY px.location, px.variable, px.obs_date)",
    ]


THREE = [*cells_sql("region"), donors_sql("region", 3)]


def joint_fill(expression: str, *ctes: str, digits: int = 3) -> str:
    return with_(*THREE, *ctes) + f"SELECT c.location, c.variable, c.obs_date, {R(expression, digits)} AS filled FROM cells c LEFT JOIN est USING (location, variable, obs_date) WHERE c.value IS NULL"


def _three(spark: SparkSession, sf: str) -> DataFrame:
    return T.donors(spark, sf, "region", 3)


@query(joint_fill("e", *joint_sql(1, 20, scaled=True)))
def impute_kriging_donors(spark: SparkSession, sf: str) -> DataFrame:
    return holes(joint.kriging(cells(spark, sf, "region"), _three(spark, sf)), 3)


@query(joint_fill("e", *joint_sql(1, 10)))
def impute_xloc_regr1_donors(spark: SparkSession, sf: str) -> DataFrame:
    return holes(joint.regression(cells(spark, sf, "region"), _three(spark, sf), lags=(0,)), 3)


@query(joint_fill("e", *joint_sql(3, 10)))
def impute_xloc_regression_donors(spark: SparkSession, sf: str) -> DataFrame:
    return holes(joint.regression(cells(spark, sf, "region"), _three(spark, sf)), 3)


@query(with_(*THREE, *LAGS[len(THREE):], MOVED) + ADVECTED)
def impute_advection_donors(spark: SparkSession, sf: str) -> DataFrame:
    return holes(spatial.advection(cells(spark, sf, "region"), _three(spark, sf)))


@query(with_(*THREE, *neighbours_sql(), *joint_sql(3, 10)) + f"""SELECT nb.location, nb.variable, nb.obs_date, {R(f'coalesce({LINE}, e)', 3)} AS filled
FROM nb LEFT JOIN est USING (location, variable, obs_date) WHERE value IS NULL""")
def impute_hybrid_sequential_donors(spark: SparkSession, sf: str) -> DataFrame:
    return holes(hybrid.sequential(cells(spark, sf, "region"), _three(spark, sf)), 3)


def blended_sql(t: str, s: str) -> str:
    w = f"CASE WHEN {GAP} < 3 THEN 0.8::DOUBLE WHEN {GAP} > 14 THEN 0.3::DOUBLE ELSE 0.5::DOUBLE END"
    return f"coalesce(({w}) * {t} + (1 - ({w})) * {s}, {t}, {s})"


@query(with_(*THREE, *neighbours_sql(), *joint_sql(1, 20, scaled=True)) + f"""SELECT nb.location, nb.variable, nb.obs_date, {R(blended_sql(EDGES, 'e'), 3)} AS filled
FROM nb LEFT JOIN est USING (location, variable, obs_date) WHERE value IS NULL""")
def impute_hybrid_ensemble_donors(spark: SparkSession, sf: str) -> DataFrame:
    return holes(hybrid.gap_ensemble(cells(spark, sf, "region"), _three(spark, sf)), 3)


@query(with_(*THREE, *neighbours_sql(), *joint_sql(1, 20, scaled=True)) + f"""SELECT nb.location, nb.variable, nb.obs_date, {R(blended_sql(f'coalesce({EDGES}, 0)', 'coalesce(e, 0)'), 3)} AS filled
FROM nb LEFT JOIN est USING (location, variable, obs_date) WHERE value IS NULL""")
def impute_hybrid_zero_fill(spark: SparkSession, sf: str) -> DataFrame:
    """The ensemble that reads a missing leg as 0."""
    return holes(hybrid.gap_ensemble(cells(spark, sf, "region"), _three(spark, sf), zero_fill=True), 3)


@query(joint_fill("e", *joint_sql(3, 10)))
def impute_hybrid_block(spark: SparkSession, sf: str) -> DataFrame:
    """The branch for gaps in blocks."""
    return holes(hybrid.dispatch(cells(spark, sf, "region"), _three(spark, sf), "block_7day"), 3)


@query(fill_sql(EDGES, *cells_sql("region"), *neighbours_sql()))
def impute_hybrid_random(spark: SparkSession, sf: str) -> DataFrame:
    """The branch for random gaps."""
    return holes(hybrid.dispatch(cells(spark, sf, "region"), _three(spark, sf), "random_10"))


@query(with_(*cells_sql("region")) + f"""SELECT location, variable, obs_date, {R('m')} AS filled FROM (
  SELECT *, avg(value) OVER (PARTITION BY location, variable, dayofyear(obs_date)) AS m FROM cells) WHERE value IS NULL""")
def impute_hybrid_rolling_origin(spark: SparkSession, sf: str) -> DataFrame:
    """The branch for the time after a cut."""
    return holes(hybrid.dispatch(cells(spark, sf, "region"), _three(spark, sf), "rolling_origin_180"))


# --- hybrid --------------------------------------------------------------------

SEQ_CTES = [
    *cells_sql("region"), donors_sql("region"), *neighbours_sql("cells"),
    *LAGGED[len(cells_sql("region")) + 1:], COEF,
]


@query(with_(*SEQ_CTES) + f"""SELECT p.location, p.variable, p.obs_date, {R(f'coalesce({LINE}, {REGR3})', 3)} AS filled
FROM pairs p JOIN nb ON nb.location = p.location AND nb.variable = p.variable AND nb.obs_date = p.obs_date LEFT JOIN coef k ON {ON_PAIR} WHERE p.value IS NULL""")
def impute_hybrid_sequential(spark: SparkSession, sf: str) -> DataFrame:
    return holes(hybrid.sequential(cells(spark, sf, "region"), T.donors(spark, sf, "region"), single=True), 3)


W = f"CASE WHEN {GAP} < 3 THEN 0.8::DOUBLE WHEN {GAP} > 14 THEN 0.3::DOUBLE ELSE 0.5::DOUBLE END"


@query(with_(
    *PAIRS, KRIGE, *neighbours_sql(),
    f"""legs AS (SELECT p.location, p.variable, p.obs_date, p.value, {EDGES} AS t, {KRIGE_EST} AS s, {W} AS w FROM pairs p
  JOIN nb ON nb.location = p.location AND nb.variable = p.variable AND nb.obs_date = p.obs_date LEFT JOIN krige k ON {ON_PAIR})""",
) + f"SELECT location, variable, obs_date, {R('coalesce(w * t + (1 - w) * s, t, s)')} AS filled FROM legs WHERE value IS NULL")
def impute_hybrid_ensemble(spark: SparkSession, sf: str) -> DataFrame:
    return holes(hybrid.gap_ensemble(cells(spark, sf), T.donors(spark, sf, "nation"), single=True))


@query(with_(
    *NB, f"mx AS (SELECT location, variable, coalesce(max(CASE WHEN value IS NULL THEN {GAP} END), 0) AS longest FROM nb GROUP BY 1, 2)",
    "cl AS (SELECT *, avg(value) OVER (PARTITION BY location, variable, dayofyear(obs_date)) AS m FROM nb)",
) + f"""SELECT location, variable, obs_date, {R(f'CASE WHEN longest <= 7 THEN {EDGES} ELSE m END')} AS filled FROM cl JOIN mx USING (location, variable) WHERE value IS NULL""")
def impute_hybrid_dispatch(spark: SparkSession, sf: str) -> DataFrame:
    """The branch for patterns without a rule of their own: per series by longest gap."""
    return holes(hybrid.dispatch(cells(spark, sf), T.donors(spark, sf, "nation"), "other"))


@query(with_(
    *LAGGED, COEF, "cl AS (SELECT location, variable, dayofyear(obs_date) AS doy, avg(value) AS m FROM cells GROUP BY 1, 2, 3)",
    f"""e AS (SELECT p.location, p.variable, p.obs_date, cl.m AS c, {REGR3} AS g FROM pairs p LEFT JOIN coef k ON {ON_PAIR}
  LEFT JOIN cl ON cl.location = p.location AND cl.variable = p.variable AND cl.doy = dayofyear(p.obs_date) WHERE p.value IS NULL)""",
) + f"SELECT location, variable, obs_date, {R('coalesce((c + g) / 2, c, g)', 3)} AS filled FROM e")
def impute_hybrid_seasonal(spark: SparkSession, sf: str) -> DataFrame:
    return holes(hybrid.dispatch(cells(spark, sf, "region"), T.donors(spark, sf, "region"), "seasonal", single=True), 3)


@query(with_(
    *PAIRS, KRIGE, f"f1 AS (SELECT p.location, p.variable, p.obs_date, p.value, coalesce(p.value, {KRIGE_EST}) AS v FROM pairs p LEFT JOIN krige k ON {ON_PAIR})",
    """f2 AS (SELECT *, coalesce(v, last_value(v IGNORE NULLS) OVER (PARTITION BY location, variable ORDER BY obs_date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  first_value(v IGNORE NULLS) OVER (PARTITION BY location, variable ORDER BY obs_date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS w FROM f1)""",
    "md AS (SELECT variable, quantile_cont(w, 0.5) AS m FROM f2 GROUP BY 1)",
) + f"SELECT location, variable, obs_date, {R('coalesce(w, m)')} AS filled FROM f2 JOIN md USING (variable) WHERE value IS NULL")
def impute_registry(spark: SparkSession, sf: str) -> DataFrame:
    """A registered method followed by previous/next fill and the median."""
    return holes(hybrid.impute(cells(spark, sf), "kriging", T.donors(spark, sf, "nation"), single=True))
