"""All registered queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lacuna.operators import masking, metrics, temporal
from lacuna.plans import (
    forecast_queries, gap_queries, impute_queries, metric_queries, model_queries, panel_queries, stream_queries,
)
from lacuna.plans.common import R, cells, cells_sql, neighbours_sql, rr, with_
from lacuna.plans.gap_queries import random_sql
from lacuna.plans.study import scores_sql


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Orders to a daily panel per region; cut a tenth of the observed cells; interpolate;
    score the fills per site and variable with their coverage."""
    masked = masking.apply_mask(masking.Strategy("random_10").apply(cells(spark, sf, "region")))
    filled = temporal.linear(masked).filter("is_masked")
    out = metrics.fill_scores(filled, ["location", "variable"])
    return rr(out, "coverage", "rmse", "mae", "r2")


FLAGSHIP_SQL = with_(
    *cells_sql("region"), random_sql("0.1::DOUBLE"),
    "holed AS (SELECT location, variable, obs_date, value AS truth, is_masked, CASE WHEN NOT is_masked THEN value END AS value FROM masked)",
    *neighbours_sql("holed"),
    "filled AS (SELECT location, variable, truth, coalesce(pval + (nval - pval) / (npos - ppos) * (pos - ppos), pval, nval) AS filled FROM nb WHERE is_masked)",
    scores_sql("location, variable", "filled"),
) + f"SELECT location, variable, missing_count, filled_count, {R('coverage')} AS coverage, {R('rmse')} AS rmse, {R('mae')} AS mae, {R('r2')} AS r2 FROM results"

MODULES = (
    panel_queries, gap_queries, impute_queries, metric_queries, model_queries, forecast_queries, stream_queries,
)
QUERIES = {"flagship": flagship, **{k: v for m in MODULES for k, v in m.QUERIES.items()}}
SQL = {"flagship": FLAGSHIP_SQL, **{k: v for m in MODULES for k, v in m.SQL.items()}}
