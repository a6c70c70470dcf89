"""Registered queries: the prediction log as a stream over the event files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.plans.common import R, r
from lacuna.session import fresh_path
from lacuna.sources.day_log import read_log
from lacuna.sources.tables import table
from lacuna.streaming import prediction_log as log

QUERIES, SQL = {}, {}


def stream_prediction_log(spark: SparkSession, sf: str) -> DataFrame:
    """Events through ``foreachBatch`` into the log; a second run over the same log adds
    nothing."""
    path = fresh_path(spark, "log")
    for run in ("a", "b"):
        events = log.read_events(spark, f"{sf}/events*.parquet")
        log.append_log(events, path, f"{path}-checkpoint-{run}", run=run).awaitTermination()
    rows = spark.read.parquet(path)
    return rows.select("event_type", F.col("prediction_timestamp").cast("timestamp_ntz").alias("prediction_timestamp"), "value")


def stream_daily_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Daily windows that the watermark has closed, appended to a parquet sink."""
    path = fresh_path(spark, "totals")
    totals = log.daily_totals(log.read_events(spark, f"{sf}/events*.parquet"))
    (
        totals.writeStream.format("parquet").outputMode("append").option("path", path)
        .option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True).start().awaitTermination()
    )
    return spark.read.parquet(path).select("event_type", "day", "n", r("total", 2).alias("total"))


def stream_log_by_day(spark: SparkSession, sf: str) -> DataFrame:
    """The same log as one file a day, fed twice with the same events."""
    path = fresh_path(spark, "daylog")
    for run in ("a", "b"):
        log.log_by_day(log.read_events(spark, f"{sf}/events*.parquet"), path, f"{path}-checkpoint-{run}").awaitTermination()
    rows = read_log(spark, path, "event_type string, prediction_timestamp timestamp, value double")
    return rows.select("event_type", F.col("prediction_timestamp").cast("timestamp_ntz").alias("prediction_timestamp"), "value")


def stream_daily_totals_closed(spark: SparkSession, sf: str) -> DataFrame:
    """Daily totals of the stream, and of the days it had to leave open."""
    path = fresh_path(spark, "totals")
    totals = log.daily_totals(log.read_events(spark, f"{sf}/events*.parquet"))
    (
        totals.writeStream.format("parquet").outputMode("append").option("path", path)
        .option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True).start().awaitTermination()
    )
    closed = spark.read.schema("event_type string, day date, n long, total double").parquet(path)
    events = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return log.close_totals(closed, events).select("event_type", "day", "n", r("total", 2).alias("total"))


QUERIES["stream_log_by_day"] = stream_log_by_day
SQL["stream_log_by_day"] = """SELECT event_type, min(ts) AS prediction_timestamp, arg_min(value, ts) AS value FROM events GROUP BY event_type, CAST(ts AS DATE)"""
QUERIES["stream_daily_totals_closed"] = stream_daily_totals_closed
SQL["stream_daily_totals_closed"] = f"""SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n, {R('sum(value)', 2)} AS total FROM events GROUP BY 1, 2"""
QUERIES["stream_prediction_log"] = stream_prediction_log
SQL["stream_prediction_log"] = """SELECT event_type, min(ts) AS prediction_timestamp, arg_min(value, ts) AS value FROM events GROUP BY event_type, CAST(ts AS DATE)"""
QUERIES["stream_daily_totals"] = stream_daily_totals
SQL["stream_daily_totals"] = f"""SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n, {R('sum(value)', 2)} AS total FROM events
GROUP BY 1, 2 HAVING CAST(ts AS DATE) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY"""
