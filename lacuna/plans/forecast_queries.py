"""Registered queries: zonal extraction and forecast serving."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.functions import expr as E
from lacuna.operators import forecast as FC
from lacuna.operators import zonal
from lacuna.plans.common import R, labels_sql, order_days, panel_sql, r, rr, spined, spined_sql, with_
from lacuna.plans.impute_queries import RUN, run_date
from lacuna.plans.metric_queries import SCORED
from lacuna.sources import tables as T

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn
    return add


# --- zonal ---------------------------------------------------------------------

GRID = """grid AS (SELECT (l_partkey % 100) / 10.0::DOUBLE AS lat, (l_suppkey % 100) / 10.0::DOUBLE AS lon, CAST(l_linenumber AS DOUBLE) AS depth, CAST(l_shipdate AS DATE) AS obs_date,
  CASE WHEN l_linenumber <> 7 THEN l_quantity END AS u, CASE WHEN l_linenumber <> 7 THEN l_extendedprice / 1000.0::DOUBLE END AS v, l_partkey AS qa, l_discount * 400 AS cloud_pct FROM lineitem)"""


def boxes_sql(pad: float) -> str:
    p = f"{pad!r}::DOUBLE"
    return f"""boxes AS (SELECT r_name AS site, r_regionkey * 2.0::DOUBLE - {p} AS lon_min, r_regionkey * 2.0::DOUBLE + 1.5 + {p} AS lon_max,
  r_regionkey * 1.5::DOUBLE - {p} AS lat_min, r_regionkey * 1.5::DOUBLE + 2.0 + {p} AS lat_max FROM region)"""


@query(with_(boxes_sql(0.125)) + f"SELECT site, {R('lon_min')} AS lon_min, {R('lon_max')} AS lon_max, {R('lat_min')} AS lat_min, {R('lat_max')} AS lat_max, {R('(lon_max - lon_min) * (lat_max - lat_min) * 12321.0', 2)} AS area_km2 FROM boxes")
def site_bbox(spark: SparkSession, sf: str) -> DataFrame:
    b = zonal.site_boxes(T.sites(spark, sf), 0.125)
    return b.select("site", *[r(c).alias(c) for c in ("lon_min", "lon_max", "lat_min", "lat_max")], r("area_km2", 2).alias("area_km2"))


@query(with_(GRID, boxes_sql(0.125)) + f"""SELECT site, obs_date, {R('avg(u)')} AS u, {R('avg(v)')} AS v FROM grid g JOIN boxes b
  ON g.lat BETWEEN b.lat_min AND b.lat_max AND g.lon BETWEEN b.lon_min AND b.lon_max GROUP BY 1, 2""")
def zonal_mean(spark: SparkSession, sf: str) -> DataFrame:
    cells = zonal.canonical_dimensions(T.grid_cells(spark, sf).withColumnsRenamed({"lat": "latitude", "lon": "nav_lon"}))
    return rr(zonal.zonal_mean(cells, zonal.site_boxes(T.sites(spark, sf), 0.125), ["u", "v"]), "u", "v")


@query(with_(GRID) + f"SELECT lat, lon, obs_date, min(depth) AS depth, arg_min(u, (depth, u)) AS u FROM grid WHERE u IS NOT NULL AND depth BETWEEN 2 AND 6 GROUP BY 1, 2, 3")
def surface_level(spark: SparkSession, sf: str) -> DataFrame:
    return zonal.surface(T.grid_cells(spark, sf), "u", ["lat", "lon", "obs_date"], (2.0, 6.0))


@query(with_(GRID) + f"""SELECT obs_date, {R('avg(sqrt(u * u + v * v))')} AS per_cell, {R('sqrt(avg(u) * avg(u) + avg(v) * avg(v))')} AS of_means FROM grid WHERE u IS NOT NULL AND v IS NOT NULL GROUP BY 1""")
def wind_speed_modes(spark: SparkSession, sf: str) -> DataFrame:
    g = T.grid_cells(spark, sf)
    a = zonal.wind_speed(g, ["obs_date"]).withColumnRenamed("wind_speed", "per_cell")
    b = zonal.wind_speed(g, ["obs_date"], "of_means").withColumnRenamed("wind_speed", "of_means")
    return rr(a.join(b, "obs_date"), "per_cell", "of_means")


@query("SELECT (l_partkey & 3072) = 0 AS clear, count(*) AS n, sum(l_partkey)::BIGINT AS total FROM lineitem GROUP BY 1")
def qa_bitmask(spark: SparkSession, sf: str) -> DataFrame:
    g = T.grid_cells(spark, sf)
    return g.groupBy(E.clear_sky(F.col("qa")).alias("clear")).agg(F.count(F.lit(1)).alias("n"), F.sum("qa").alias("total"))


@query(with_(GRID) + f"SELECT obs_date, {R('avg((u - v) / nullif(u + v, 0))')} AS ndvi FROM grid WHERE cloud_pct < 30 AND (qa & 3072) = 0 GROUP BY 1")
def ndvi_index(spark: SparkSession, sf: str) -> DataFrame:
    g = T.grid_cells(spark, sf)
    return rr(zonal.ndvi(g, ["obs_date"], F.col("u"), F.col("v"), F.col("cloud_pct"), F.col("qa")), "ndvi")


COARSE = "coarse AS (SELECT CAST(floor(lat) AS INTEGER) AS lat, CAST(floor(lon) AS INTEGER) AS lon, year(obs_date) AS y, avg(u) AS u FROM grid GROUP BY 1, 2, 3)"


def _coarse(spark: SparkSession, sf: str) -> DataFrame:
    g = T.grid_cells(spark, sf)
    one = lambda c: F.floor(c).cast("int").alias(c)
    return g.groupBy(one("lat"), one("lon"), F.year("obs_date").alias("y")).agg(F.avg("u").alias("u"))


def _slope(across: str, along: str) -> str:
    w = f"(PARTITION BY y, {across} ORDER BY {along})"
    return f"""CASE WHEN lag(1) OVER {w} IS NULL AND lead(1) OVER {w} IS NULL THEN NULL WHEN lag(1) OVER {w} IS NULL THEN lead(u) OVER {w} - u
    WHEN lead(1) OVER {w} IS NULL THEN u - lag(u) OVER {w} ELSE (lead(u) OVER {w} - lag(u) OVER {w}) / 2 END"""


@query(with_(GRID, COARSE, f"g2 AS (SELECT y, {_slope('lat', 'lon')} AS gx, {_slope('lon', 'lat')} AS gy FROM coarse)")
+ f"SELECT CAST(y AS INTEGER) AS y, {R('avg(gx)')} AS grad_x, {R('avg(gy)')} AS grad_y, {R('sqrt(avg(gx) * avg(gx) + avg(gy) * avg(gy))')} AS gradient FROM g2 GROUP BY 1")
def spatial_gradient(spark: SparkSession, sf: str) -> DataFrame:
    return rr(zonal.spatial_gradient(_coarse(spark, sf), ["y"], "u"), "grad_x", "grad_y", "gradient")


@query(with_(GRID) + f"SELECT obs_date, {R('var_pop(u)')} AS variance FROM grid GROUP BY 1")
def spatial_variance(spark: SparkSession, sf: str) -> DataFrame:
    return rr(zonal.spatial_variance(T.grid_cells(spark, sf), ["obs_date"], "u"), "variance")


# --- forecast ------------------------------------------------------------------

SIGNAL = [
    *labels_sql(),
    f"""sg AS (SELECT location, CAST(min(CASE WHEN label >= 0.5 THEN date_diff('day', obs_date, {RUN}) END) AS INTEGER) AS days_since_last_positive,
    avg(CASE WHEN date_diff('day', obs_date, {RUN}) <= 90 THEN CASE WHEN label >= 0.5 THEN 1 ELSE 0 END END) AS r90,
    avg(CASE WHEN date_diff('day', obs_date, {RUN}) <= 365 THEN CASE WHEN label >= 0.5 THEN 1 ELSE 0 END END) AS r365 FROM label_rows WHERE obs_date <= {RUN} GROUP BY 1)""",
    "sig AS (SELECT *, coalesce(days_since_last_positive <= 90, false) OR coalesce(r90 >= 0.15, false) OR coalesce(r365 >= 0.10, false) AS has_signal FROM sg)",
]


@query(with_(*SIGNAL) + "SELECT location, days_since_last_positive, round(r90, 3) AS recent_positive_rate_90d, round(r365, 3) AS recent_positive_rate_365d, has_signal FROM sig")
def recent_signal(spark: SparkSession, sf: str) -> DataFrame:
    return FC.recent_signal(T.urgent_labels(spark, sf), run_date(spark, sf))


def ladder_sql(p: str, steps=E.DAILY_LADDER, floor: str = "Very Low Risk", op: str = ">=") -> str:
    return "CASE " + " ".join(f"WHEN {p} {op} {b!r} THEN '{name}'" for b, name in steps) + f" ELSE '{floor}' END"


@query(with_(*SCORED) + f"SELECT {ladder_sql('lstm')} AS daily, {ladder_sql('lstm', E.SERVICE_LADDER)} AS service, {ladder_sql('lstm', E.HORIZON_LADDER, 'Low Risk', '>')} AS horizon, count(*) AS n FROM wide GROUP BY ALL")
def risk_ladder(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("prob")
    one = T.scores(spark, sf).filter(F.col("model") == "lstm")
    return one.groupBy(
        E.ladder(p).alias("daily"), E.ladder(p, E.SERVICE_LADDER).alias("service"), E.ladder(p, E.HORIZON_LADDER, "Low Risk", inclusive=False).alias("horizon")
    ).agg(F.count(F.lit(1)).alias("n"))


# One forecast per nation: the last panel row before the run date, some inputs missing by
# rule, probability from the day's order value.
ROWS = [
    *SIGNAL, panel_sql("nation")[1],
    """lastrow AS (SELECT location, max(obs_date) AS obs_date, arg_max(balance, obs_date) AS balance, arg_max(n_orders, obs_date) AS n_orders, arg_max(total, obs_date) AS total FROM panel GROUP BY 1)""",
    """inp AS (SELECT n.n_nationkey AS k, l.location, CASE WHEN n.n_nationkey % 4 <> 1 THEN total / 100 END AS "CHL", CASE WHEN n.n_nationkey % 3 <> 0 THEN balance / 100 END AS thetao,
    CASE WHEN n.n_nationkey % 4 <> 1 THEN n_orders + 30 END AS so, CASE WHEN n.n_nationkey % 5 <> 2 THEN n_orders * 2 END AS precip_mm_day, round(total * 7 % 1000) / 1000.0::DOUBLE AS probability
  FROM lastrow l JOIN nation n ON n.n_name = l.location)""",
    """dq AS (SELECT *, (CASE WHEN "CHL" IS NULL THEN 0 ELSE 1 END + CASE WHEN thetao IS NULL THEN 0 ELSE 1 END + CASE WHEN so IS NULL THEN 0 ELSE 1 END + CASE WHEN precip_mm_day IS NULL THEN 0 ELSE 1 END) AS critical_available FROM inp)""",
    "dq2 AS (SELECT *, critical_available / 4.0::DOUBLE AS critical_ratio, critical_available / 4.0::DOUBLE AS observed_ratio FROM dq)",
    "dq3 AS (SELECT d.*, critical_ratio < 0.5 OR observed_ratio < 0.7 AS data_limited, has_signal AND d.k % 2 = 0 AS has_signal FROM dq2 d LEFT JOIN sig s USING (location))",
    f"""rk AS (SELECT *, {ladder_sql('probability')} AS r0, CASE WHEN data_limited THEN least(0.5 + abs(probability - 0.5), 0.65::DOUBLE) ELSE 0.5 + abs(probability - 0.5) END AS c0 FROM dq3)""",
    "rk1 AS (SELECT *, CASE WHEN data_limited AND r0 = 'Very Low Risk' THEN 'Low Risk' ELSE r0 END AS r1 FROM rk)",
    """fc AS (SELECT *, CASE WHEN has_signal AND r1 IN ('Very Low Risk', 'Low Risk') THEN 'Moderate Risk' ELSE r1 END AS risk_level,
    CASE WHEN has_signal AND r1 IN ('Very Low Risk', 'Low Risk') THEN least(c0, 0.7::DOUBLE) ELSE c0 END AS confidence FROM rk1)""",
]
INPUTS = ["CHL", "thetao", "so", "precip_mm_day"]


def forecast_rows(spark: SparkSession, sf: str) -> DataFrame:
    from lacuna.operators.panel import latest_per_location

    last = latest_per_location(T.orders_panel(spark, sf, "nation"))
    n = T.table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("location"))
    k = F.col("k")
    inp = last.join(n, "location").select(
        "k", "location", F.when(k % 4 != 1, F.col("total") / 100).alias("CHL"), F.when(k % 3 != 0, F.col("balance") / 100).alias("thetao"),
        F.when(k % 4 != 1, F.col("n_orders") + 30).alias("so"), F.when(k % 5 != 2, F.col("n_orders") * 2).alias("precip_mm_day"),
        (F.round(F.col("total") * 7 % 1000) / F.lit(1000.0)).alias("probability"),
    )
    sig = FC.recent_signal(T.urgent_labels(spark, sf), run_date(spark, sf)).select("location", "has_signal")
    dq = FC.data_quality(inp, INPUTS, FC.CRITICAL_VARIABLES).join(sig, "location", "left")
    return FC.risk(dq.withColumn("has_signal", F.col("has_signal") & (F.col("k") % 2 == 0)))


@query(with_(*ROWS) + f"SELECT location, {R('probability')} AS probability, risk_level, {R('confidence')} AS confidence, has_signal FROM fc")
def risk_adjust(spark: SparkSession, sf: str) -> DataFrame:
    out = forecast_rows(spark, sf).select("location", "probability", "risk_level", "confidence", "has_signal")
    return rr(out, "probability", "confidence")


@query(with_(*ROWS) + "SELECT location, CAST(critical_available AS INTEGER) AS critical_available, critical_ratio, observed_ratio, data_limited FROM fc")
def data_quality(spark: SparkSession, sf: str) -> DataFrame:
    return forecast_rows(spark, sf).select("location", "critical_available", "critical_ratio", "observed_ratio", "data_limited")


HORIZON = [
    *ROWS, f"""hz AS (SELECT location, i AS forecast_day, {RUN} + i AS date, probability * pow(0.9::DOUBLE, i) AS p, CASE WHEN confidence > 0.7 THEN greatest(0.5, confidence * pow(0.95::DOUBLE, i)) ELSE confidence * pow(0.95::DOUBLE, i) END AS c
  FROM fc CROSS JOIN (SELECT unnest(generate_series(1, 6))::INTEGER AS i))""",
]


@query(with_(*HORIZON) + f"SELECT location, forecast_day, CAST(date AS DATE) AS date, strftime(CAST(date AS DATE), '%a') AS day_label, {ladder_sql('p', E.HORIZON_LADDER, 'Low Risk', '>')} AS risk_level, {R('c')} AS confidence, {R('p')} AS probability FROM hz")
def horizon_decay(spark: SparkSession, sf: str) -> DataFrame:
    return rr(FC.horizon(forecast_rows(spark, sf), run_date(spark, sf)), "confidence", "probability")


@query(with_(*ROWS) + f"""SELECT location, {RUN} AS run_date, risk_level, printf('%.1f%%', confidence * 100) AS confidence, split_part(risk_level, ' ', 1) AS red_tide_probability,
  CAST(CASE WHEN data_limited THEN 5 ELSE 3 END AS INTEGER) AS n_recommendations, CAST(6 AS INTEGER) AS n_days, CASE WHEN data_limited THEN 'Low' ELSE 'High' END AS quality,
  CASE WHEN data_limited THEN 'Forecast' WHEN has_signal THEN 'Moderate' WHEN risk_level LIKE 'High%' THEN 'Elevated' WHEN risk_level LIKE 'Moderate%' THEN 'Moderate' WHEN risk_level LIKE 'Very%' THEN 'Very' ELSE 'Low' END AS explanation,
  coalesce(CAST(round(so, 2) AS VARCHAR) || ' PSU', 'N/A') AS salinity FROM fc""")
def forecast_document(spark: SparkSession, sf: str) -> DataFrame:
    """Nested forecast documents, written as JSON by run date and read back."""
    from lacuna.session import fresh_path
    from lacuna.sources.files import write_forecasts

    rows = forecast_rows(spark, sf).withColumn("latitude", F.lit(10.0) + F.col("k") / 10).withColumn("longitude", F.lit(120.0) + F.col("k") / 10)
    docs = FC.document(rows, run_date(spark, sf))
    path = fresh_path(spark, "forecasts")
    write_forecasts(docs, path)
    back = spark.read.schema(docs.schema).json(path)
    return back.select(
        "location", "run_date", "risk_level", "confidence", "red_tide_probability", F.size("recommendations").alias("n_recommendations"),
        F.size("five_day_forecast").alias("n_days"), F.col("data_quality.confidence_level").alias("quality"),
        F.split_part("explanation", F.lit(" "), F.lit(1)).alias("explanation"), F.col("environmental_data.`Salinity (PSU)`").alias("salinity"),
    )


CARDS = """cards AS (SELECT event_type AS location, CAST(ts AS DATE) AS forecast_date, max(ts) AS created_at, CASE WHEN sum(value) % 3 < 1 THEN 'High Risk' WHEN sum(value) % 3 < 2 THEN 'Moderate Risk' ELSE 'Low Risk' END AS risk_level, count(*) AS confidence
  FROM (SELECT event_type, ts, CAST(value * 100 AS BIGINT) AS value FROM events) GROUP BY 1, 2)"""


def _cards(spark: SparkSession, sf: str) -> DataFrame:
    e = T.table(spark, sf, "events").select("event_type", "ts", F.round(F.col("value") * 100).cast("long").alias("value"))
    s = F.sum("value") % 3
    return e.groupBy(F.col("event_type").alias("location"), F.to_date("ts").alias("forecast_date")).agg(
        F.max("ts").alias("created_at"), F.when(s < 1, "High Risk").when(s < 2, "Moderate Risk").otherwise("Low Risk").alias("risk_level"),
        F.count(F.lit(1)).alias("confidence"),
    )


@query(with_(CARDS) + """SELECT upper(t.location) || ' Bay' AS location, t.forecast_date, t.risk_level, t.location || 'bay' AS location_key, y.risk_level AS yesterday_risk, y.confidence AS yesterday_confidence
FROM cards t LEFT JOIN cards y ON y.location = t.location AND y.forecast_date = t.forecast_date - 1""")
def yesterday_join(spark: SparkSession, sf: str) -> DataFrame:
    c = _cards(spark, sf)
    today = c.select(F.concat(F.upper("location"), F.lit(" Bay")).alias("location"), "forecast_date", "risk_level")
    return FC.yesterday(today, _cards(spark, sf).withColumn("location", F.concat("location", F.lit("_bay"))))


@query("SELECT regexp_replace(lower(text), '[^\\p{L}\\p{N}]', '', 'g') AS location_key, count(*) AS n FROM conversations GROUP BY 1")
def location_key(spark: SparkSession, sf: str) -> DataFrame:
    t = T.table(spark, sf, "conversations")
    return t.groupBy(E.location_key(F.col("text")).alias("location_key")).agg(F.count(F.lit(1)).alias("n"))


COLOUR = """CASE WHEN l LIKE '%red%' OR l LIKE '%high%' THEN 'red' WHEN l LIKE '%orange%' OR l LIKE '%moderate%' THEN 'orange' WHEN l LIKE '%very low%' THEN 'green' WHEN l LIKE '%low%' THEN 'yellow' ELSE 'green' END"""
KEY = """CASE WHEN l LIKE '%red%' OR l LIKE '%high%' THEN 'red' WHEN l LIKE '%orange%' OR l LIKE '%moderate%' THEN 'orange' WHEN l LIKE '%yellow%' OR l LIKE '%low%' THEN 'yellow' ELSE 'green' END"""


@query(with_(*SCORED, f"lv AS (SELECT lower({ladder_sql('lstm')}) AS l FROM wide UNION ALL SELECT lower(o_orderpriority) FROM orders)") + f"SELECT l AS level, {COLOUR} AS colour, {KEY} AS key, count(*) AS n FROM lv GROUP BY ALL")
def risk_colour(spark: SparkSession, sf: str) -> DataFrame:
    p = T.scores(spark, sf).filter(F.col("model") == "lstm").select(E.ladder(F.col("prob")).alias("x"))
    lv = p.union(T.table(spark, sf, "orders").select("o_orderpriority"))
    x = F.col("x")
    return lv.groupBy(F.lower(x).alias("level"), E.risk_colour(x).alias("colour"), E.risk_key(x).alias("key")).agg(F.count(F.lit(1)).alias("n"))


@query(with_(*ROWS, "sm AS (SELECT *, lower(risk_level) AS l, round(confidence * 100 + 1e-5, 1) AS conf FROM fc)", f"sk AS (SELECT *, {KEY} AS key FROM sm)")
+ f"""SELECT {RUN} AS run_date, count(*) AS total_locations, {', '.join(f"CAST(sum(CASE WHEN key = '{c}' THEN 1 ELSE 0 END) AS BIGINT) AS {c}" for c in ('green', 'yellow', 'orange', 'red'))},
  round(avg(conf) + 1e-5, 1) AS average_confidence, round(avg(observed_ratio), 1) AS data_quality_avg, CAST(sum(CASE WHEN key IN ('red', 'orange') THEN 1 ELSE 0 END) AS BIGINT) AS elevated_locations FROM sk""")
def forecast_summary(spark: SparkSession, sf: str) -> DataFrame:
    rows = forecast_rows(spark, sf).select(
        "location", "risk_level", F.concat(F.round(F.col("confidence") * 100 + 1e-5, 1).cast("string"), F.lit("%")).alias("confidence"),
        F.col("observed_ratio").alias("quality_score"), run_date(spark, sf).alias("run_date"),
    )
    return FC.summary(rows)


@query(with_(*ROWS) + "SELECT location, risk_level FROM fc WHERE risk_level IN ('High Risk', 'Moderate Risk')")
def high_risk_sites(spark: SparkSession, sf: str) -> DataFrame:
    return FC.elevated_sites(forecast_rows(spark, sf)).select("location", "risk_level")


@query(with_(*HORIZON, f"cd AS (SELECT location, forecast_day - 1 AS day, CAST(date AS DATE) AS date, {ladder_sql('p', E.HORIZON_LADDER, 'Low Risk', '>')} AS risk_level, round(c + 1e-8, 4) AS confidence FROM hz WHERE forecast_day <= 3 + length(location) % 4)",
"mx AS (SELECT location, max(day) AS md FROM cd GROUP BY 1)", "sp AS (SELECT mx.location, md, unnest(generate_series(0, 7))::INTEGER AS day FROM mx)")
+ "SELECT sp.location, sp.day, CAST(cd.date + greatest(sp.day - md, 0) AS DATE) AS date, cd.risk_level, cd.confidence FROM sp JOIN cd ON cd.location = sp.location AND cd.day = least(sp.day, md)")
def outlook_pad(spark: SparkSession, sf: str) -> DataFrame:
    h = FC.horizon(forecast_rows(spark, sf), run_date(spark, sf)).filter(F.col("forecast_day") <= 3 + F.length("location") % 4)
    cards = h.select("location", (F.col("forecast_day") - 1).alias("day"), "date", "risk_level", r("confidence").alias("confidence"))
    return FC.pad_outlook(cards, 8)


MONTHLY = [*labels_sql(), "monthly AS (SELECT strftime(obs_date, '%Y-%m') AS label, CAST(sum(CASE WHEN label >= 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS value FROM label_rows GROUP BY 1)"]


@query(with_(*MONTHLY) + "SELECT label, value FROM monthly")
def monthly_alerts(spark: SparkSession, sf: str) -> DataFrame:
    return FC.monthly_alerts(FC.alerts(T.urgent_labels(spark, sf)))


@query(with_(*labels_sql()) + """SELECT obs_date, CAST(sum(CASE WHEN label >= 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS value FROM label_rows WHERE location = 'NATION_3' AND obs_date BETWEEN DATE '1996-02-01' AND DATE '1998-06-30' GROUP BY 1""")
def daily_timeline(spark: SparkSession, sf: str) -> DataFrame:
    return FC.daily_timeline(FC.alerts(T.urgent_labels(spark, sf), "nation 3", "1996-02-01", "1998-06-30"))


@query(with_(*MONTHLY) + "SELECT substr(label, 1, 4) || '-Q' || CAST((CAST(substr(label, 6, 2) AS INTEGER) + 2) // 3 AS VARCHAR) AS period, CAST(sum(value) AS BIGINT) AS value FROM monthly GROUP BY 1")
def quarterly_alerts(spark: SparkSession, sf: str) -> DataFrame:
    return FC.quarterly_alerts(FC.monthly_alerts(FC.alerts(T.urgent_labels(spark, sf))))


@query(with_(*MONTHLY) + "SELECT CAST(m AS INTEGER) AS month, coalesce(value, 0) AS value FROM (SELECT unnest(generate_series(1, 12)) AS m) LEFT JOIN monthly ON label = '2001-' || lpad(CAST(m AS VARCHAR), 2, '0')")
def year_month_zero_fill(spark: SparkSession, sf: str) -> DataFrame:
    return FC.year_by_month(FC.monthly_alerts(FC.alerts(T.urgent_labels(spark, sf))), 2001)


@query(with_(*ROWS) + f"""SELECT {R('avg("CHL")')} AS mean_chlorophyll, {R('avg(thetao)')} AS mean_sst, {R('avg(so)')} AS mean_salinity, {R('sum(precip_mm_day)')} AS total_precipitation, count("CHL") AS sites_with_chlorophyll FROM fc""")
def env_overview(spark: SparkSession, sf: str) -> DataFrame:
    rows = forecast_rows(spark, sf).withColumnsRenamed({"CHL": "chlorophyll", "thetao": "sst", "so": "salinity", "precip_mm_day": "precipitation"})
    return rr(FC.environment_overview(rows), "mean_chlorophyll", "mean_sst", "mean_salinity", "total_precipitation")


@query(with_(*labels_sql()) + "SELECT CAST(least(greatest(year(obs_date), 1997), 2000) - 1996 AS INTEGER) AS split_num, count(*) AS n FROM label_rows GROUP BY 1")
def split_routing(spark: SparkSession, sf: str) -> DataFrame:
    return T.urgent_labels(spark, sf).groupBy(FC.split_for_year(F.col("obs_date"), 2000, 1997).alias("split_num")).agg(F.count(F.lit(1)).alias("n"))


@query(with_(*labels_sql()) + """SELECT min(obs_date) AS first_day, max(obs_date) AS last_day, CAST(date_diff('day', min(obs_date), max(obs_date)) + 1 AS INTEGER) AS days, CAST(sum(CASE WHEN label >= 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS alerts FROM label_rows""")
def alert_range(spark: SparkSession, sf: str) -> DataFrame:
    return FC.alert_range(FC.alerts(T.urgent_labels(spark, sf)))


@query(with_(*ROWS) + f"SELECT location, risk_level, {R('confidence')} AS confidence FROM fc WHERE location = 'NATION_7'")
def location_forecast(spark: SparkSession, sf: str) -> DataFrame:
    """The forecast of one site, asked for by a name written differently."""
    found = FC.find_location(forecast_rows(spark, sf), "nation 7")
    return rr(found.select("location", "risk_level", "confidence"), "confidence")


SHOWN = [
    *ROWS, """shown AS (SELECT f.location, coalesce(CASE WHEN f.k % 5 = 0 THEN f.k * 1.5 END, CASE WHEN f.k % 3 = 0 THEN f.so + 100 END, f.so, l.n_orders + 200) AS so, coalesce(f.thetao, l.balance) AS thetao, "CHL" AS chl
  FROM fc f JOIN lastrow l USING (location))""",
]


@query(with_(*SHOWN) + """SELECT location, coalesce(CAST(round(so, 2)::DOUBLE AS VARCHAR) || ' PSU', 'N/A') AS salinity, round(thetao, 2) AS sst, round(chl, 3) AS chl_a FROM shown""")
def display_values(spark: SparkSession, sf: str) -> DataFrame:
    """What a forecast document shows of a variable: live reading, raw input, model input, latest history."""
    from lacuna.operators.panel import latest_per_location

    last = latest_per_location(T.orders_panel(spark, sf, "nation")).select("location", (F.col("n_orders") + 200).alias("latest_so"), F.col("balance").alias("latest_thetao"))
    k = F.col("k")
    rows = forecast_rows(spark, sf).join(last, "location").withColumns({
        "live_so": F.when(k % 5 == 0, k * F.lit(1.5)), "raw_so": F.when(k % 3 == 0, F.col("so") + 100), "latitude": F.lit(0.0), "longitude": F.lit(0.0),
    })
    docs = FC.document(rows, run_date(spark, sf))
    return docs.select(
        "location", F.col("environmental_data.`Salinity (PSU)`").alias("salinity"), F.col("contributing_factors.sst").alias("sst"), F.col("contributing_factors.`chl-a`").alias("chl_a"),
    )


def _written(spark: SparkSession, df: DataFrame, fmt: str) -> str:
    from lacuna.session import fresh_path
    from lacuna.sources.files import write_results

    path = fresh_path(spark, f"results-{fmt}")
    write_results(df, path, fmt)
    return path


@query(with_(*MONTHLY) + "SELECT f AS format, label, value FROM monthly, (SELECT unnest(['csv', 'parquet']) AS f)")
def results_files(spark: SparkSession, sf: str) -> DataFrame:
    """Monthly results written as CSV with a header and as Parquet, and read back."""
    monthly = FC.monthly_alerts(FC.alerts(T.urgent_labels(spark, sf)))
    text = spark.read.option("header", True).schema("label string, value long").csv(_written(spark, monthly, "csv"))
    table = spark.read.schema("label string, value long").parquet(_written(spark, monthly, "parquet"))
    return text.select(F.lit("csv").alias("format"), "label", "value").unionByName(table.select(F.lit("parquet").alias("format"), "label", "value"))


@query(with_(*spined_sql("region")) + f"SELECT location, obs_date, {R('balance')} AS balance, {R('n_orders')} AS n_orders, {R('total')} AS total FROM spined")
def panel_csv(spark: SparkSession, sf: str) -> DataFrame:
    """The daily panel through a CSV file: empty fields and NaN come back as missing."""
    from lacuna.sources.files import read_panel_csv

    panel = spined(spark, sf, "region")
    text = panel.withColumn("total", F.coalesce("total", F.lit(float("nan"))))
    return rr(read_panel_csv(spark, _written(spark, text, "csv"), T.VARIABLES).select("location", "obs_date", *T.VARIABLES), *T.VARIABLES)
