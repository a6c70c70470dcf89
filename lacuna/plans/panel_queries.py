"""Registered queries: sources, stores, panel assembly, lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.functions import expr as E
from lacuna.operators import lookup, panel as P
from lacuna.plans.common import (
    R, VARS, DAYS, cells, cells_sql, donors_sql, order_days, pairs_sql, panel_sql, places, r, rr, spined, spined_sql, with_,
)
from lacuna.session import fresh_path
from lacuna.sources import files, stores, tables as T

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn
    return add


@query(with_(*panel_sql("region")) + f"SELECT location, obs_date, {R('balance')} AS balance, n_orders, {R('total')} AS total FROM panel")
def panel_scan(spark: SparkSession, sf: str) -> DataFrame:
    return rr(T.orders_panel(spark, sf, "region"), "balance", "total")


@query("""SELECT event_type, ts_day, sum(amount) AS amount, count(*) AS n FROM (
  SELECT event_type, TRY_CAST(CASE WHEN event_id % 7 = 0 THEN 'not a date' ELSE CAST(CAST(ts AS DATE) AS VARCHAR) END AS DATE) AS ts_day,
    coalesce(TRY_CAST(CASE WHEN event_id % 5 = 0 THEN 'n/a' ELSE regexp_extract(props, '[0-9]+') END AS DOUBLE), 0) AS amount
  FROM events) WHERE ts_day IS NOT NULL GROUP BY event_type, ts_day""")
def lenient_parse(spark: SparkSession, sf: str) -> DataFrame:
    e = T.table(spark, sf, "events")
    text = e.select(
        "event_type",
        F.when(F.col("event_id") % 7 == 0, "not a date").otherwise(F.to_date("ts").cast("string")).alias("ts_day"),
        F.when(F.col("event_id") % 5 == 0, "n/a").otherwise(F.regexp_extract("props", "[0-9]+", 0)).alias("amount"),
    )
    return files.lenient(text, "ts_day", ["amount"]).groupBy("event_type", "ts_day").agg(
        F.sum("amount").alias("amount"), F.count(F.lit(1)).alias("n")
    )


@query(f"""SELECT location, CAST(forecast_date AS DATE) AS run_date, n_events, {R('value', 2)} AS value FROM (
  SELECT event_type AS location, CAST(ts AS DATE) AS forecast_date, count(*) AS n_events, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS value
  FROM events GROUP BY 1, 2) WHERE forecast_date = (SELECT max(CAST(ts AS DATE)) FROM events)""")
def latest_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    daily = T.daily_events(spark, sf).withColumnRenamed("obs_date", "run_date")
    return files.latest_snapshot(daily).select("location", "run_date", "n_events", r("value", 2).alias("value"))


RINGS = """SELECT r_name AS site, CAST(5 AS INTEGER) AS points, '[[' || w || ',' || s || '],[' || e || ',' || s || '],[' || e || ',' || n || '],[' || w || ',' || n || '],[' || w || ',' || s || ']]' AS ring
FROM (SELECT r_name, CAST(r_regionkey * 2.0::DOUBLE AS VARCHAR) AS w, CAST(r_regionkey * 2.0::DOUBLE + 1.5 AS VARCHAR) AS e,
  CAST(r_regionkey * 1.5::DOUBLE AS VARCHAR) AS s, CAST(r_regionkey * 1.5::DOUBLE + 2.0 AS VARCHAR) AS n FROM region)"""


@query(RINGS)
def geojson_sites(spark: SparkSession, sf: str) -> DataFrame:
    """Region polygons as one feature collection per region, written, read and parsed."""
    point = F.struct(F.lit("Polygon").alias("type"), F.array("ring").alias("coordinates"))
    feature = F.struct(F.struct(F.col("site").alias("name")).alias("properties"), point.alias("geometry"))
    doc = F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.array(feature).alias("features"))).alias("value")
    path = fresh_path(spark, "sites")
    T.sites(spark, sf).select(doc).write.text(path)
    lines = spark.read.text(path).withColumnRenamed("value", "text")
    return files.parse_geojson(lines).select("site", F.size("ring").alias("points"), F.to_json("ring").alias("ring"))


@query(RINGS)
def geojson_features(spark: SparkSession, sf: str) -> DataFrame:
    """The same polygons as one collection in one file, read feature by feature."""
    point = F.struct(F.lit("Polygon").alias("type"), F.array("ring").alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(F.col("site").alias("name")).alias("properties"), point.alias("geometry"))
    doc = F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.collect_list(feature).alias("features"))).alias("value")
    path = fresh_path(spark, "collection")
    T.sites(spark, sf).select(doc).write.text(path)
    return files.read_geojson_features(spark, path).select("site", F.size("ring").alias("points"), F.to_json("ring").alias("ring"))


@query(with_(*panel_sql("nation")) + f"""SELECT n_nationkey AS location_id, obs_date AS date, coalesce(n_orders > 1, false) AS redtide_present,
  {R('balance')} AS sst, {R('total')} AS chlorophyll_a_proxy FROM panel JOIN nation ON n_name = location WHERE n_regionkey < 3""")
def history_load(spark: SparkSession, sf: str) -> DataFrame:
    dim = T.table(spark, sf, "nation").filter(F.col("n_regionkey") < 3).select(
        F.col("n_nationkey").alias("location_id"), F.col("n_name").alias("location_name")
    )
    rows = stores.history_rows(
        T.orders_panel(spark, sf, "nation"), dim, {"balance": "sst", "total": "chlorophyll_a_proxy"}, "n_orders", 1.0
    )
    return rr(rows, "sst", "chlorophyll_a_proxy")


@query("""WITH dim AS (SELECT n_nationkey AS location_id, n_name AS location_name FROM nation WHERE n_regionkey < 2),
fresh AS (SELECT DISTINCT c_mktsegment AS location_name FROM customer UNION SELECT n_name FROM nation)
SELECT CAST(row_number() OVER (ORDER BY md5(location_name)) + (SELECT max(location_id) FROM dim) AS INTEGER) AS location_id, location_name
FROM fresh WHERE location_name NOT IN (SELECT location_name FROM dim)""")
def location_dim_upsert(spark: SparkSession, sf: str) -> DataFrame:
    nation = T.table(spark, sf, "nation")
    dim = nation.filter("n_regionkey < 2").select(F.col("n_nationkey").alias("location_id"), F.col("n_name").alias("location_name"))
    names = T.table(spark, sf, "customer").select(F.col("c_mktsegment").alias("location_name")).union(nation.select("n_name"))
    return stores.new_locations(names, dim)


@query("""WITH b AS (SELECT event_type AS location_id, ts AS prediction_timestamp, value FROM events),
log AS (SELECT DISTINCT event_type AS location_id, CAST(ts AS DATE) AS d FROM events WHERE event_type = 'error' AND ts < TIMESTAMP '2024-01-11'),
one AS (SELECT location_id, CAST(prediction_timestamp AS DATE) AS d, min(prediction_timestamp) AS t FROM b GROUP BY 1, 2)
SELECT o.location_id, CAST(o.t AS TIMESTAMP) AS prediction_timestamp FROM one o
WHERE NOT EXISTS (SELECT 1 FROM log l WHERE l.location_id = o.location_id AND l.d = o.d)""")
def prediction_log_append(spark: SparkSession, sf: str) -> DataFrame:
    e = T.table(spark, sf, "events").select(F.col("event_type").alias("location_id"), F.col("ts").alias("prediction_timestamp"))
    log = e.filter((F.col("location_id") == "error") & (F.col("prediction_timestamp") < F.lit("2024-01-11").cast("timestamp_ntz")))
    return stores.new_predictions(e, log)


@query(with_(*panel_sql("region"), """ev AS (SELECT event_type AS location, CAST(ts AS DATE) AS obs_date, CAST(count(*) AS BIGINT) AS n_events FROM events GROUP BY 1, 2)""")
+ f"""SELECT location, obs_date, n_events, n_orders, {R('total')} AS total FROM (SELECT coalesce(p.location, e.location) AS location,
  coalesce(p.obs_date, e.obs_date) AS obs_date, n_events, n_orders, total FROM panel p FULL OUTER JOIN ev e ON p.location = e.location AND p.obs_date = e.obs_date)""")
def panel_full_outer(spark: SparkSession, sf: str) -> DataFrame:
    a = T.orders_panel(spark, sf, "region").select("location", "obs_date", "n_orders", r("total").alias("total"))
    b = T.daily_events(spark, sf).select("location", "obs_date", "n_events")
    return P.full_outer(a, b)


@query(with_(*panel_sql("region"), """ship AS (SELECT l_returnflag AS location, CAST(l_shipdate AS DATE) AS obs_date,
  CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS quantity FROM lineitem GROUP BY 1, 2)""")
+ f"""SELECT location, obs_date, {R('balance')} AS balance, NULL::DOUBLE AS quantity FROM panel
UNION ALL SELECT location, obs_date, NULL::DOUBLE, quantity FROM ship""")
def panel_union(spark: SparkSession, sf: str) -> DataFrame:
    a = T.orders_panel(spark, sf, "region").select("location", "obs_date", r("balance").alias("balance"))
    b = T.ship_panel(spark, sf).select("location", "obs_date", "quantity")
    return P.union_sites([a, b])


@query("""SELECT event_type, CAST(ts AS DATE) AS obs_date, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(value, (ts, event_id)) AS value
FROM events GROUP BY 1, 2""")
def dedup_keep_last(spark: SparkSession, sf: str) -> DataFrame:
    e = T.table(spark, sf, "events").select("event_type", F.to_date("ts").alias("obs_date"), "ts", "event_id", "value")
    return P.dedup(e, ["event_type", "obs_date"], ["ts", "event_id"]).drop("ts")


@query(with_(*spined_sql("nation")) + f"SELECT location, obs_date, {R('balance')} AS balance, n_orders, {R('total')} AS total FROM spined")
def daily_spine(spark: SparkSession, sf: str) -> DataFrame:
    return rr(spined(spark, sf, "nation"), "balance", "total")


@query(with_(*panel_sql("region"), """ev AS (SELECT event_type, CAST(ts AS DATE) AS d, count(*) AS n FROM events GROUP BY 1, 2)""",
"""live AS (SELECT location, obs_date, CASE WHEN n_orders > 1 THEN total * 2 END AS total, balance + 1 AS balance FROM panel WHERE day(obs_date) % 3 = 0)""",
"""marine AS (SELECT location, obs_date, CASE WHEN day(obs_date) % 4 = 0 THEN total * 3 END AS total FROM panel WHERE day(obs_date) % 2 = 0)""")
+ f"""SELECT p.location, p.obs_date, {R('coalesce(m.total, l.total, p.total)')} AS total, {R('coalesce(l.balance, p.balance)')} AS balance,
  CASE WHEN m.location IS NOT NULL AND l.location IS NOT NULL THEN 'marine+atmospheric' WHEN m.location IS NOT NULL THEN 'marine'
       WHEN l.location IS NOT NULL THEN 'atmospheric' ELSE 'historical_latest' END AS source
FROM panel p LEFT JOIN live l USING (location, obs_date) LEFT JOIN marine m USING (location, obs_date)""")
def source_precedence(spark: SparkSession, sf: str) -> DataFrame:
    p = T.orders_panel(spark, sf, "region").select("location", "obs_date", "total", "balance")
    d = F.dayofmonth("obs_date")
    live = p.filter(d % 3 == 0).join(T.orders_panel(spark, sf, "region").select("location", "obs_date", "n_orders"), ["location", "obs_date"]).select(
        "location", "obs_date", F.when(F.col("n_orders") > 1, F.col("total") * 2).alias("total"), (F.col("balance") + 1).alias("balance")
    )
    marine = p.filter(d % 2 == 0).select("location", "obs_date", F.when(d % 4 == 0, F.col("total") * 3).alias("total"))
    out = P.precedence_merge(p, [("marine", marine), ("atmospheric", live)], ["total", "balance"])
    return rr(out, "total", "balance")


@query(f"""SELECT event_id, TRY_CAST(v AS DOUBLE) AS thetao, TRY_CAST(k AS DOUBLE) AS so, {R("abs(TRY_CAST(v AS DOUBLE)) * 10")} AS "CHL",
  TRY_CAST(k AS DOUBLE) AS "NDVI_raw" FROM (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'bad' ELSE CAST(-value AS VARCHAR) END AS v,
  regexp_extract(props, '[0-9]+') AS k FROM events)""")
def live_field_map(spark: SparkSession, sf: str) -> DataFrame:
    v = F.when(F.col("event_id") % 11 == 0, "bad").otherwise((-F.col("value")).cast("string"))
    k = F.regexp_extract("props", "[0-9]+", 0)
    names = {"SST": v, "Salinity": k, "Rainfall_mm": v, "Wind_speed_ms": k, "Wind_u_ms": v, "Wind_v_ms": k, "Chlorophyll_a_proxy": v, "NDVI": k}
    text = T.table(spark, sf, "events").select("event_id", *[e.alias(n) for n, e in names.items()])
    out = P.live_field_map(text, ["event_id"])
    return out.select("event_id", "thetao", "so", r("CHL").alias("CHL"), "NDVI_raw")


@query(with_(*spined_sql("region")) + "SELECT obs_date, " + ", ".join(
    f"max(CASE WHEN location = '{x}' THEN {R(v)} END) AS \"{v}_{x}\"" for v in ("balance", "total") for x in ("ASIA", "EUROPE"))
    + " FROM spined GROUP BY obs_date")
def panel_pivot(spark: SparkSession, sf: str) -> DataFrame:
    """Long to cells and back, then to one row per date."""
    wide = P.to_wide(cells(spark, sf, "region"), VARS)
    out = P.sites_wide(wide, ["balance", "total"], ["ASIA", "EUROPE"])
    return rr(out, *[c for c in out.columns if c != "obs_date"])


@query(with_(*panel_sql("nation")) + f"SELECT location, max(obs_date) AS obs_date, {R('arg_max(total, obs_date)')} AS total FROM panel GROUP BY location")
def latest_per_location(spark: SparkSession, sf: str) -> DataFrame:
    return rr(P.latest_per_location(T.orders_panel(spark, sf, "nation").select("location", "obs_date", "total")), "total")


@query(with_(*cells_sql("region"), donors_sql("region", 2), pairs_sql()) + f"""SELECT location, donor, variable, obs_date, {R('value')} AS value,
  {R('donor_value')} AS donor_value FROM pairs WHERE value IS NOT NULL AND donor_value IS NOT NULL""")
def site_pair_join(spark: SparkSession, sf: str) -> DataFrame:
    pairs = P.with_donor(cells(spark, sf, "region"), T.donors(spark, sf, "region", 2)).dropna(subset=["value", "donor_value"])
    return pairs.select("location", "donor", "variable", "obs_date", r("value").alias("value"), r("donor_value").alias("donor_value"))


READINGS = """reads AS (SELECT n_name AS location, CAST(o_orderdate AS DATE) AS obs_date, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / CAST(1000 AS DOUBLE) AS reading
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus = 'P' GROUP BY 1, 2)"""


def _readings(spark: SparkSession, sf: str) -> DataFrame:
    o = T.table(spark, sf, "orders").filter(F.col("o_orderstatus") == "P").select("o_custkey", "o_totalprice", F.to_date("o_orderdate").alias("obs_date"))
    c = T.table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    n = T.table(spark, sf, "nation").select("n_nationkey", F.col("n_name").alias("location"))
    j = o.join(c.join(n, F.col("c_nationkey") == F.col("n_nationkey")), F.col("o_custkey") == F.col("c_custkey"))
    return j.groupBy("location", "obs_date").agg((T.money("o_totalprice") / F.lit(1000.0)).alias("reading"))


@query(with_(*spined_sql("nation"), READINGS) + f"""SELECT s.location, s.obs_date, x.obs_date AS source_date, CAST(date_diff('day', x.obs_date, s.obs_date) AS INTEGER) AS age_days, {R('x.reading')} AS reading
FROM spined s ASOF LEFT JOIN reads x ON s.location = x.location AND s.obs_date >= x.obs_date""".replace("x.obs_date AS source_date", "CASE WHEN date_diff('day', x.obs_date, s.obs_date) <= 7 THEN x.obs_date END AS source_date")
.replace("CAST(date_diff('day', x.obs_date, s.obs_date) AS INTEGER) AS age_days", "CASE WHEN date_diff('day', x.obs_date, s.obs_date) <= 7 THEN CAST(date_diff('day', x.obs_date, s.obs_date) AS INTEGER) END AS age_days")
.replace(R('x.reading'), f"CASE WHEN date_diff('day', x.obs_date, s.obs_date) <= 7 THEN {R('x.reading')} END"))
def asof_tolerance(spark: SparkSession, sf: str) -> DataFrame:
    targets = spined(spark, sf, "nation").select("location", "obs_date")
    return rr(lookup.asof(targets, _readings(spark, sf), ["reading"], 7), "reading")


NEAREST = (
    with_(*spined_sql("nation"), READINGS,
    "lo AS (SELECT s.location, s.obs_date, x.obs_date AS d, x.reading AS v FROM spined s ASOF LEFT JOIN reads x ON s.location = x.location AND s.obs_date >= x.obs_date)",
    "hi AS (SELECT s.location, s.obs_date, x.obs_date AS d, x.reading AS v FROM spined s ASOF LEFT JOIN reads x ON s.location = x.location AND s.obs_date <= x.obs_date)",
    """both_ AS (SELECT location, obs_date, lo.d AS ld, lo.v AS lv, hi.d AS hd, hi.v AS hv,
      coalesce(date_diff('day', obs_date, hi.d) < date_diff('day', lo.d, obs_date), lo.d IS NULL) AS later FROM lo JOIN hi USING (location, obs_date))""")
    + f"""SELECT location, obs_date, CASE WHEN later THEN hd ELSE ld END AS source_date,
      CAST(abs(date_diff('day', obs_date, CASE WHEN later THEN hd ELSE ld END)) AS INTEGER) AS days_apart, {R('CASE WHEN later THEN hv ELSE lv END')} AS reading FROM both_"""
)


@query(NEAREST)
def asof_nearest(spark: SparkSession, sf: str) -> DataFrame:
    targets = spined(spark, sf, "nation").select("location", "obs_date")
    return rr(lookup.nearest_date(targets, _readings(spark, sf), ["reading"]), "reading")


@query(f"""SELECT lower(n_name) || ' bay' AS alias, x.obs_date, source_date, days_apart, reading FROM nation JOIN ({NEAREST}) x ON x.location = n_name WHERE n_nationkey % 2 = 0
  UNION ALL SELECT lower(n_name) || ' bay', obs_date, NULL, NULL, NULL FROM nation, ({NEAREST}) y WHERE y.location = n_name AND n_nationkey % 2 = 1""")
def asof_alias(spark: SparkSession, sf: str) -> DataFrame:
    """Nearest readings of sites known by another name; the names of every second one are not in the table."""
    nation = T.table(spark, sf, "nation")
    bay = F.concat(F.lower("n_name"), F.lit(" bay"))
    names = nation.filter(F.col("n_nationkey") % 2 == 0).select(bay.alias("alias"), F.col("n_name").alias("name"))
    asked = spined(spark, sf, "nation").select(F.concat(F.lower("location"), F.lit(" bay")).alias("location"), "obs_date")
    placed = lookup.by_alias(asked, names)
    found = lookup.nearest_date(placed.select("location", "obs_date"), _readings(spark, sf), ["reading"])
    out = placed.join(found, ["location", "obs_date"], "left")
    return rr(out.select("alias", "obs_date", "source_date", "days_apart", "reading"), "reading")



@query(with_(*spined_sql("nation")) + f"""SELECT location, obs_date, {R("sum(total) OVER (w RANGE BETWEEN INTERVAL 3 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING)", 3)} AS sum3,
  {R("avg(n_orders) OVER (w RANGE BETWEEN INTERVAL 3 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING)")} AS mean3,
  {R("avg(balance) OVER (w RANGE BETWEEN INTERVAL 15 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING)", 3)} AS mean15
FROM spined WINDOW w AS (PARTITION BY location ORDER BY obs_date)""")
def trailing_env(spark: SparkSession, sf: str) -> DataFrame:
    out = lookup.trailing(
        spined(spark, sf, "nation"),
        {"sum3": (F.sum("total"), 3), "mean3": (F.avg("n_orders"), 3), "mean15": (F.avg("balance"), 15)},
    )
    return out.select("location", "obs_date", r("sum3", 3).alias("sum3"), r("mean3").alias("mean3"), r("mean15", 3).alias("mean15"))
