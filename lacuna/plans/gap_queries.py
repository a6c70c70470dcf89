"""Registered queries: gaps, masks, splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.operators import gaps, masking, splits
from lacuna.plans.common import (
    GAP, R, cells, cells_sql, neighbours_sql, order_days, r, spined, spined_sql, with_,
)
from lacuna.session import fresh_path
from lacuna.sources import files, tables as T

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn
    return add


@query(with_(*cells_sql(), *neighbours_sql()) + """SELECT location, variable, min(obs_date) AS gap_start, max(obs_date) AS gap_end, count(*) AS gap_length
FROM nb WHERE value IS NULL GROUP BY location, variable, coalesce(ppos, -1)""")
def gap_runs(spark: SparkSession, sf: str) -> DataFrame:
    return gaps.gap_runs(cells(spark, sf))


@query(with_(*cells_sql(), *neighbours_sql()) + f"SELECT location, variable, obs_date, CAST({GAP} AS BIGINT) AS gap_length FROM nb WHERE value IS NULL")
def gap_size_per_cell(spark: SparkSession, sf: str) -> DataFrame:
    rows = gaps.with_gaps(cells(spark, sf)).filter(F.col("value").isNull())
    return rows.select("location", "variable", "obs_date", "gap_length")


def hash_sql(*parts: str) -> str:
    return "md5('42' || " + " || ".join(f"'|' || CAST({p} AS VARCHAR)" for p in parts) + ")"


CELL_HASH = hash_sql("variable", "location", "obs_date")


def random_sql(rate: str, pool: str = "variable", src: str = "cells", name: str = "masked") -> str:
    return f"""{name} AS (SELECT *, value IS NOT NULL AND rn <= floor(n * {rate}) AS is_masked FROM (
    SELECT *, row_number() OVER (PARTITION BY {pool}, value IS NULL ORDER BY {CELL_HASH}) AS rn, count(value) OVER (PARTITION BY {pool}) AS n FROM {src}))"""


WET = "month(obs_date) IN (6,7,8,9,10)"
SEASONAL_RATE = f"CASE WHEN {WET} THEN 0.4::DOUBLE ELSE 0.1::DOUBLE END"


def block_sql(length: int, blocks: int, src: str = "cells", name: str = "masked") -> list[str]:
    return [
        f"""{name}_s AS (SELECT *, CAST(floor((row_number() OVER (PARTITION BY location, variable ORDER BY obs_date) - 1) / {length}) AS BIGINT) AS slot FROM {src})""",
        f"""{name}_c AS (SELECT location, variable, slot, count(*) AS n, sum(count(value)) OVER (PARTITION BY location, variable) AS observed
  FROM {name}_s GROUP BY 1, 2, 3)""",
        f"""{name}_k AS (SELECT location, variable, slot FROM (SELECT *, row_number() OVER (PARTITION BY location, variable ORDER BY {hash_sql("variable", "location", "slot")}) AS rk
  FROM {name}_c WHERE n = {length} AND observed >= {length}) WHERE rk <= {blocks})""",
        f"""{name} AS (SELECT s.location, s.obs_date, s.variable, s.value, k.slot IS NOT NULL AS is_masked
  FROM {name}_s s LEFT JOIN {name}_k k ON s.location = k.location AND s.variable = k.variable AND s.slot = k.slot)""",
    ]


def rolling_sql(window: int = 90, k: int = 4, src: str = "cells", name: str = "masked") -> list[str]:
    return [
        f"""bounds AS (SELECT CAST(min(o_orderdate) AS DATE) AS lo, CAST(max(o_orderdate) AS DATE) AS hi FROM orders)""",
        f"""splits AS (SELECT i AS split_num, lo + step * i AS cutoff, lo + step * i + 1 AS test_start, lo + step * i + {window} AS test_end FROM (
    SELECT lo, CAST(floor((date_diff('day', lo, hi) - {window}) / {k + 1}) AS INTEGER) AS step, unnest(generate_series(1, {k}))::INTEGER AS i FROM bounds))""",
        f"""{name} AS (SELECT c.*, s.split_num, c.obs_date BETWEEN s.test_start AND s.test_end AS is_masked FROM {src} c CROSS JOIN splits s)""",
    ]


MASKED = "SELECT location, variable, obs_date FROM masked WHERE is_masked"


def _masked(df: DataFrame) -> DataFrame:
    return df.filter("is_masked").select("location", "variable", "obs_date")


@query(with_(*cells_sql(), random_sql("0.1::DOUBLE")) + MASKED)
def mask_random(spark: SparkSession, sf: str) -> DataFrame:
    return _masked(masking.Strategy("random_10").apply(cells(spark, sf)))


@query(with_(*cells_sql(), *block_sql(7, 8)) + MASKED)
def mask_block(spark: SparkSession, sf: str) -> DataFrame:
    return _masked(masking.Strategy("block_7day").apply(cells(spark, sf)))


@query(with_(*cells_sql(), random_sql(SEASONAL_RATE, f"variable, {WET}")) + MASKED)
def mask_seasonal(spark: SparkSession, sf: str) -> DataFrame:
    return _masked(masking.Strategy("seasonal").apply(cells(spark, sf)))


PERIODS = (("1996-06-01", "1996-06-30"), ("1997-08-01", "1997-09-15"))


@query(with_(*cells_sql()) + """SELECT location, variable, obs_date FROM cells WHERE variable IN ('balance', 'total')
  AND (obs_date BETWEEN DATE '1996-06-01' AND DATE '1996-06-30' OR obs_date BETWEEN DATE '1997-08-01' AND DATE '1997-09-15')""")
def mask_cross_variable(spark: SparkSession, sf: str) -> DataFrame:
    s = masking.Strategy("cross_variable", {"variables": ("balance", "total"), "periods": PERIODS})
    return _masked(s.apply(cells(spark, sf)))


@query(with_(*cells_sql(), *rolling_sql()) + f"SELECT split_num, location, variable, obs_date, {R('value')} AS value FROM masked WHERE is_masked")
def mask_rolling_origin(spark: SparkSession, sf: str) -> DataFrame:
    m = masking.Strategy("rolling_origin").apply(cells(spark, sf), bounds=order_days(spark, sf))
    return m.filter("is_masked").select("split_num", "location", "variable", "obs_date", r("value").alias("value"))


@query(with_(*rolling_sql(src="nation")[:2]) + "SELECT split_num, CAST(cutoff AS DATE) AS cutoff, CAST(test_start AS DATE) AS test_start, CAST(test_end AS DATE) AS test_end FROM splits")
def rolling_splits(spark: SparkSession, sf: str) -> DataFrame:
    days = T.table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("obs_date"))
    one = days.agg(F.min("obs_date").alias("lo"), F.max("obs_date").alias("hi"))
    return one.select(F.inline(splits.rolling_splits(days, splits.RollingOrigin(90, 4), (F.col("lo"), F.col("hi")))))


RATE = "CASE WHEN total_cells > originally_missing THEN round(masked_cells / (total_cells - originally_missing) * 100, 2) ELSE 0 END"


@query(with_(*cells_sql(), *block_sql(7, 8)) + f"""SELECT variable, total_cells, originally_missing, masked_cells, {RATE} AS masked_rate_pct FROM (
  SELECT variable, count(*) AS total_cells, CAST(sum(CASE WHEN value IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS originally_missing,
    CAST(sum(CASE WHEN is_masked THEN 1 ELSE 0 END) AS BIGINT) AS masked_cells FROM masked GROUP BY ROLLUP (variable))""")
def mask_stats(spark: SparkSession, sf: str) -> DataFrame:
    return masking.mask_stats(masking.Strategy("block_7day").apply(cells(spark, sf)))


@query(with_(*cells_sql("region"), *rolling_sql()) + f"""SELECT 'rolling_origin' AS mask_type, split_num, location, variable, obs_date, is_masked,
  {R('CASE WHEN NOT is_masked THEN value END')} AS value FROM masked WHERE split_num = 2""")
def masked_partitions(spark: SparkSession, sf: str) -> DataFrame:
    """Masked sets written as ``mask_type=/split_num=`` and one split read back by pruning."""
    m = masking.apply_mask(masking.Strategy("rolling_origin").apply(cells(spark, sf, "region"), bounds=order_days(spark, sf)))
    path = fresh_path(spark, "masked")
    files.write_masked(m.withColumn("mask_type", F.lit("rolling_origin")), path)
    back = files.read_masked(spark, path, "rolling_origin", 2)
    return back.select("mask_type", "split_num", "location", "variable", "obs_date", "is_masked", r("value").alias("value"))


YEARS = """ysplits AS (SELECT i + 1 AS split_num, make_date(1996 + i - 1, 12, 31) AS cutoff, make_date(1996 + i, 1, 1) AS test_start,
  make_date(1996 + i + CASE WHEN i = 4 THEN 1 ELSE 0 END, 12, 31) AS test_end FROM (SELECT unnest(generate_series(0, 4))::INTEGER AS i))"""


@query(with_(*spined_sql("region"), YEARS) + """SELECT CAST(split_num AS INTEGER) AS split_num, location, role, count(*) AS n, count(total) AS observed, min(obs_date) AS first_day, max(obs_date) AS last_day FROM (
  SELECT s.split_num, p.*, CASE WHEN p.obs_date <= s.cutoff THEN 'train' ELSE 'test' END AS role FROM spined p JOIN ysplits s
    ON p.obs_date <= s.cutoff OR p.obs_date BETWEEN s.test_start AND s.test_end) GROUP BY split_num, location, role""")
def yearly_splits(spark: SparkSession, sf: str) -> DataFrame:
    rows = splits.assign_roles(spined(spark, sf, "region"), splits.yearly_splits(1996, 5, 2))
    return rows.groupBy("split_num", "location", "role").agg(
        F.count(F.lit(1)).alias("n"), F.count("total").alias("observed"), F.min("obs_date").alias("first_day"), F.max("obs_date").alias("last_day")
    )


@query("""WITH d AS (SELECT obs_date, row_number() OVER (ORDER BY obs_date) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS obs_date FROM orders)),
s AS (SELECT unnest(generate_series(1, 6))::INTEGER AS k)
SELECT k AS split_num, max(CASE WHEN i = n - k - 365 THEN obs_date END) AS cutoff, max(CASE WHEN i = n - k - 364 THEN obs_date END) AS test_start,
  max(CASE WHEN i = n - k THEN obs_date END) AS test_end FROM d, s WHERE n - k - 365 >= 365 AND i IN (n - k, n - k - 364, n - k - 365) GROUP BY k""")
def date_index_splits(spark: SparkSession, sf: str) -> DataFrame:
    days = T.table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("obs_date"))
    return splits.date_index_splits(days)
