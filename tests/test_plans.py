"""Contract and plan checks of the registered queries."""

import re

import duckdb
import pytest

import __spark_entry__ as entry_module
from lacuna.plans import catalogue
from lacuna.sources import tables as T

# Queries that write or fit at build time; the others only build a plan.
EAGER = {
    "geojson_sites", "masked_partitions", "forecast_document", "impute_eof_pca", "gradient_regression_impute", "site_attributes", "ens_stacked",
    "gbt_regressor", "gbt_random_search", "gbt_search_ledger", "gbt_refit", "gbt_importance", "method_split_eval", "stream_prediction_log", "stream_daily_totals",
    "stream_log_by_day", "stream_daily_totals_closed", "results_files", "panel_csv", "geojson_features",
}
STUDY = {
    "impute_metrics", "method_results", "method_summary", "category_rollup", "decay_by_gap", "method_pattern_pivot", "method_rank",
    "best_method_per_pattern", "regression_bloom_metrics", "master_comparison", "missing_metric_report", "topk_importance", "error_distribution",
}
LAZY = sorted(set(catalogue.QUERIES) - EAGER - STUDY)


def plan(spark, df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", LAZY)
def test_no_cross_product_and_no_python_in_the_plan(spark, sf, name):
    text = plan(spark, catalogue.QUERIES[name](spark, sf))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    if name != "impute_knn":
        assert not re.search(r"PythonUDF|MapInPandas|FlatMapCoGroupsInPandas|BatchEvalPython|ArrowEvalPython", text)


def test_scan_reads_only_what_it_needs(spark, sf):
    text = catalogue.QUERIES["impute_linear"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    schemas = re.findall(r"ReadSchema: (struct<[^>]*>?)", text)
    assert schemas and all("o_orderstatus" not in s and "c_mktsegment" not in s for s in schemas)


def test_linear_scans_the_orders_once_and_shares_the_chunk_exchange(spark, sf):
    df = catalogue.QUERIES["impute_linear"](spark, sf)
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")
    assert "ReusedExchange" in "".join(final)


def test_chunk_summaries_are_merged_where_the_rows_lie(spark, sf):
    df = catalogue.QUERIES["gap_runs"](spark, sf)
    df.collect()
    final = plan(spark, df).split("== Initial Plan ==")[0]
    assert re.search(r"SortMergeJoin[^\n]*_chunk", final) and not re.search(r"BroadcastHashJoin[^\n]*_chunk", final)


def test_customers_are_not_broadcast_to_their_nations(spark, sf):
    text = plan(spark, T.orders_by_place(spark, sf, "region"))
    assert re.search(r"BroadcastHashJoin \[c_nationkey#\d+\], \[n_nationkey#\d+\], Inner, BuildRight", text)


def test_every_oracle_has_a_query_and_names_agree():
    qs, sql = entry_module.queries(), entry_module.oracle_sql()
    assert set(sql) <= set(qs) and len(qs) > 120


def test_entry(spark):
    df = entry_module.entry(spark)
    assert df.columns == ["location", "variable", "missing_count", "filled_count", "coverage", "rmse", "mae", "r2"]
    assert df.count() > 0


FAST = (
    "flagship", "panel_scan", "dedup_keep_last", "prediction_log_append", "mask_random", "gap_runs", "nowcast_short_gap", "impute_xloc_regression",
    "roc_auc", "threshold_macro_f1", "zonal_mean", "horizon_decay", "quarterly_alerts", "stream_prediction_log",
)


@pytest.mark.parametrize("name", FAST)
def test_results_equal_sql(spark, sf, name):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    cur = con.execute(entry_module.oracle_sql()[name])
    cols = [c[0] for c in cur.description]
    want = sorted((tuple(r) for r in cur.fetchall()), key=str)
    got = sorted((tuple(r) for r in catalogue.QUERIES[name](spark, sf).select(*cols).collect()), key=str)
    assert got == want and got
