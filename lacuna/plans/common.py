"""Fixtures shared by the registered queries, and the same relations as SQL text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.operators.panel import daily_spine, to_cells
from lacuna.sources import tables as T

VARS = list(T.VARIABLES)


def r(c: str | Column, digits: int = 4) -> Column:
    """Rounded for comparison. The offset, a ten-thousandth of the last digit, moves exact
    halves, which engines round differently, off the boundary."""
    return F.round((F.col(c) if isinstance(c, str) else c) + F.lit(10.0 ** -(digits + 4)), digits)


def rr(df: DataFrame, *cols: str, digits: int = 4) -> DataFrame:
    return df.select(*[r(c, digits).alias(c) if c in cols else F.col(c) for c in df.columns])


def R(x: str, digits: int = 4) -> str:
    return f"round(({x}) + 1e-{digits + 4}, {digits})"


# --- Spark ---------------------------------------------------------------------


def places(spark: SparkSession, sf: str, level: str) -> DataFrame:
    t, c = ("region", "r_name") if level == "region" else ("nation", "n_name")
    return T.table(spark, sf, t).select(F.col(c).alias("location"))


def order_days(spark: SparkSession, sf: str) -> tuple[Column, Column]:
    """First and last order day: one column of one table, as scalar subqueries."""
    o = T.table(spark, sf, "orders")
    return (
        o.select(F.to_date(F.min("o_orderdate"))).scalar(),
        o.select(F.to_date(F.max("o_orderdate"))).scalar(),
    )


def spined(spark: SparkSession, sf: str, level: str) -> DataFrame:
    first, last = order_days(spark, sf)
    return daily_spine(T.orders_panel(spark, sf, level), places(spark, sf, level), first, last)


def cells(spark: SparkSession, sf: str, level: str = "nation", variables: Sequence[str] = VARS) -> DataFrame:
    return to_cells(spined(spark, sf, level), variables)


# --- SQL -----------------------------------------------------------------------


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def placed_orders(level: str) -> str:
    name, join = ("n_name", "") if level == "nation" else ("r_name", "JOIN region ON n_regionkey = r_regionkey")
    return f"""placed AS (
  SELECT {name} AS location, CAST(o_orderdate AS DATE) AS obs_date, o_totalprice, c_acctbal, o_orderpriority
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey {join})"""


PANEL = """panel AS (
  SELECT location, obs_date,
    CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS balance,
    CAST(count(*) AS DOUBLE) AS n_orders,
    CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / CAST(1000 AS DOUBLE) AS total
  FROM placed GROUP BY location, obs_date)"""

DAYS = """days AS (
  SELECT CAST(unnest(generate_series((SELECT min(o_orderdate) FROM orders), (SELECT max(o_orderdate) FROM orders), INTERVAL 1 DAY)) AS DATE) AS obs_date)"""


def panel_sql(level: str) -> list[str]:
    return [placed_orders(level), PANEL]


def spined_sql(level: str) -> list[str]:
    locs = "SELECT n_name AS location FROM nation" if level == "nation" else "SELECT r_name AS location FROM region"
    return [
        *panel_sql(level), DAYS, f"locs AS ({locs})",
        """spined AS (SELECT l.location, d.obs_date, p.balance, p.n_orders, p.total
  FROM locs l CROSS JOIN days d LEFT JOIN panel p ON p.location = l.location AND p.obs_date = d.obs_date)""",
    ]


def unpivot_sql(src: str, variables: Sequence[str] = VARS, name: str = "cells") -> str:
    parts = [f"SELECT location, obs_date, '{v}' AS variable, {v} AS value FROM {src}" for v in variables]
    return f"{name} AS (" + "\n  UNION ALL ".join(parts) + ")"


def cells_sql(level: str = "nation") -> list[str]:
    return [*spined_sql(level), unpivot_sql("spined")]


def neighbours_sql(src: str = "cells", keys: str = "location, variable", name: str = "nb") -> list[str]:
    """Positions, then the observed neighbours: p*/n* = previous and next, pp*/nn* beyond."""
    return [
        f"""{name}_p AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY obs_date) - 1 AS pos,
    count(*) OVER (PARTITION BY {keys}) - 1 AS pos_last FROM {src})""",
        f"""{name}_o AS (SELECT {keys}, pos AS opos, obs_date AS odate, value AS oval,
    lag(pos) OVER w AS bpos, lag(obs_date) OVER w AS bdate, lag(value) OVER w AS bval,
    lead(pos) OVER w AS apos, lead(obs_date) OVER w AS adate, lead(value) OVER w AS aval
  FROM {name}_p WHERE value IS NOT NULL WINDOW w AS (PARTITION BY {keys} ORDER BY obs_date))""",
        f"""{name}_j AS (SELECT p.*, o.opos, o.odate, o.oval, o.bpos, o.bdate, o.bval, o.apos, o.adate, o.aval
  FROM {name}_p p LEFT JOIN {name}_o o ON {" AND ".join(f"p.{k.strip()} = o.{k.strip()}" for k in keys.split(","))} AND p.pos = o.opos)""",
        f"""{name} AS (SELECT *,
    last_value(opos IGNORE NULLS) OVER up AS ppos, last_value(odate IGNORE NULLS) OVER up AS pdate,
    last_value(oval IGNORE NULLS) OVER up AS pval,
    first_value(opos IGNORE NULLS) OVER dn AS npos, first_value(odate IGNORE NULLS) OVER dn AS ndate,
    first_value(oval IGNORE NULLS) OVER dn AS nval,
    last_value(CASE WHEN opos IS NOT NULL THEN coalesce(bpos, -1) END IGNORE NULLS) OVER up AS pbpos,
    last_value(CASE WHEN opos IS NOT NULL THEN coalesce(bdate, DATE '0001-01-01') END IGNORE NULLS) OVER up AS pbdate,
    last_value(CASE WHEN opos IS NOT NULL THEN coalesce(bval, -1e300) END IGNORE NULLS) OVER up AS pbval,
    first_value(CASE WHEN opos IS NOT NULL THEN coalesce(apos, -1) END IGNORE NULLS) OVER dn AS napos,
    first_value(CASE WHEN opos IS NOT NULL THEN coalesce(adate, DATE '0001-01-01') END IGNORE NULLS) OVER dn AS nadate,
    first_value(CASE WHEN opos IS NOT NULL THEN coalesce(aval, -1e300) END IGNORE NULLS) OVER dn AS naval
  FROM {name}_j
  WINDOW up AS (PARTITION BY {keys} ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         dn AS (PARTITION BY {keys} ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))""",
    ]


LINE = "(pval + (nval - pval) / (npos - ppos) * (pos - ppos))"
LINE_DAY = "(pval + (nval - pval) / date_diff('day', pdate, ndate) * date_diff('day', pdate, obs_date))"
GAP = "(coalesce(npos, pos_last + 1) - coalesce(ppos, -1) - 1)"


def donors_sql(level: str = "region", per_target: int = 1) -> str:
    t, k, n = ("region", "r_regionkey", "r_name") if level == "region" else ("nation", "n_nationkey", "n_name")
    return f"""donors AS (SELECT a.{n} AS target, b.{n} AS donor, 50.0::DOUBLE * s.step AS distance_km
  FROM {t} a CROSS JOIN (SELECT unnest(generate_series(1, {per_target})) AS step) s
  JOIN {t} b ON b.{k} = (a.{k} + s.step) % (SELECT count(*) FROM {t}))"""


def pairs_sql(src: str = "cells", extra: Sequence[str] = (), name: str = "pairs") -> str:
    on = "".join(f" AND d.{e} = c.{e}" for e in extra)
    return f"""{name} AS (SELECT c.*, x.donor, x.distance_km, d.value AS donor_value
  FROM {src} c JOIN donors x ON x.target = c.location
  LEFT JOIN {src} d ON d.location = x.donor AND d.variable = c.variable AND d.obs_date = c.obs_date{on})"""


def labels_sql() -> list[str]:
    return [
        placed_orders("nation"),
        """label_rows AS (SELECT location, obs_date,
    CAST(sum(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END) AS DOUBLE) / count(*) AS label
  FROM placed GROUP BY location, obs_date)""",
    ]
