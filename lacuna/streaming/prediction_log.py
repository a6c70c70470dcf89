"""The prediction log as a stream: one entry per site and day, and daily totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.sources.day_log import add_predictions
from lacuna.sources.stores import new_predictions

EVENTS_SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """Event files as a stream; a pattern such as ``dir/events*.parquet`` selects them."""
    folder, _, pattern = path.rpartition("/")
    return (
        spark.readStream.schema(EVENTS_SCHEMA)
        .option("maxFilesPerTrigger", files_per_trigger)
        .option("pathGlobFilter", pattern)
        .parquet(folder)
        .withColumn("ts", F.col("ts").cast("timestamp"))
    )


def first_per_day(events: DataFrame, delay: str = "1 day", key: str = "event_type") -> DataFrame:
    """The first entry of each site and day that arrives; state is dropped once the
    watermark has passed."""
    day = F.date_trunc("day", "ts")
    return (
        events.withColumn("day", day)
        .withWatermark("day", delay)
        .dropDuplicatesWithinWatermark([key, "day"])
        .select(key, "day", "ts", "value")
    )


def daily_totals(events: DataFrame, delay: str = "1 day", key: str = "event_type") -> DataFrame:
    """Entries and their sum per site and day, final once the watermark has passed."""
    return (
        events.withWatermark("ts", delay)
        .groupBy(F.window("ts", "1 day").alias("w"), key)
        .agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
        .select(key, F.to_date("w.start").alias("day"), "n", "total")
    )


def append_log(events: DataFrame, log_path: str, checkpoint: str, key: str = "event_type", run: str = "daily"):
    """Append at most one row per site and day to a parquet log.

    The log is partitioned by day and batch number. A batch that is retried after a
    crash replaces its own directories, and the log it is compared with leaves its own
    rows out: nothing is lost or doubled. Only the days of the batch are read back.
    """
    schema = f"{key} string, prediction_timestamp timestamp, value double, day date, run string, epoch long"

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        rows = batch.select(key, F.col("ts").alias("prediction_timestamp"), "value")
        span = rows.agg(F.to_date(F.min("prediction_timestamp")).alias("lo"), F.to_date(F.max("prediction_timestamp")).alias("hi")).first()
        if span["lo"] is None:
            return
        spark.createDataFrame([], schema).write.mode("append").partitionBy("day", "run", "epoch").parquet(log_path)
        own = (F.col("run") == run) & (F.col("epoch") >= epoch)
        log = spark.read.schema(schema).parquet(log_path).filter(F.col("day").between(span["lo"], span["hi"]) & ~own)
        fresh = new_predictions(rows, log, (key,))
        fresh.select("*", F.to_date("prediction_timestamp").alias("day"), F.lit(run).alias("run"), F.lit(epoch).alias("epoch")).write.mode(
            "overwrite"
        ).option("partitionOverwriteMode", "dynamic").partitionBy("day", "run", "epoch").parquet(log_path)

    return (
        events.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def log_by_day(events: DataFrame, log_path: str, checkpoint: str, key: str = "event_type"):
    """As :func:`append_log`, into a :mod:`lacuna.sources.day_log`: one file a day however many batches come.

    A batch that is retried finds its rows in the log and adds nothing.
    """
    def write(batch: DataFrame, epoch: int) -> None:
        add_predictions(batch.select(key, F.col("ts").alias("prediction_timestamp"), "value"), log_path, (key,))

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def close_totals(totals: DataFrame, events: DataFrame, key: str = "event_type") -> DataFrame:
    """``totals`` of the days that the watermark has closed, and those of the days after, which it leaves open.

    Run when no more events are expected. Only events after the last closed day are read.
    """
    last = totals.select(F.max("day")).scalar()
    day = F.to_date("ts")
    open_ = events.filter(last.isNull() | (day > last)).groupBy(key, day.alias("day")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return totals.unionByName(open_)
