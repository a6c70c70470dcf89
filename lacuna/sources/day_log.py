"""A log of one file per day, changed by copying the touched days and swapping a manifest.

Data files never change. A manifest names the folder that holds each day; the newest manifest
is the log. An update writes the touched days anew, beside the old ones, and then a manifest
that names them: it becomes visible by one rename, so readers see the log before or after
an update, never between, and an update that was broken off leaves files nobody reads.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.sources.stores import new_predictions


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return jvm.org.apache.hadoop.fs.Path, place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def _versions(spark: SparkSession, log_path: str) -> list[int]:
    path, fs = _fs(spark, log_path)
    folder = path(f"{log_path}/manifests")
    if not fs.exists(folder):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    return sorted(int(n[1:]) for n in names if n.startswith("v"))


def manifest(spark: SparkSession, log_path: str) -> dict[str, str]:
    """Day -> folder of its file, by the newest manifest: at most one entry a calendar day."""
    versions = _versions(spark, log_path)
    if not versions:
        return {}
    rows = spark.read.schema("day string, folder string").json(f"{log_path}/manifests/v{versions[-1]:09d}").collect()
    return {r.day: r.folder for r in rows}


def read_log(spark: SparkSession, log_path: str, schema: str, days: Sequence[str] | None = None) -> DataFrame:
    """The log, or some days of it; an empty table of ``schema`` where there is none."""
    now = manifest(spark, log_path)
    folders = [f for d, f in now.items() if days is None or d in days]
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*sorted(folders))


def add_predictions(batch: DataFrame, log_path: str, keys: Sequence[str], ts: str = "prediction_timestamp") -> int:
    """Add at most one row per key and day, unless the log has one; the number of days written.

    Adding the same rows again changes nothing, whether the first time ended or not. Rows without
    a time belong to no day and are left out.
    """
    spark = batch.sparkSession
    schema = batch.schema.simpleString()[len("struct<") : -1].replace(":", " ")
    rows = batch.filter(F.col(ts).isNotNull())
    day = F.date_format(ts, "yyyy-MM-dd")
    touched = [r.day for r in rows.select(day.alias("day")).distinct().collect()]
    if not touched:
        return 0
    now = manifest(spark, log_path)
    log = read_log(spark, log_path, schema, touched)
    fresh = new_predictions(rows, log, keys, ts).select(*batch.columns)
    folder = f"{log_path}/data/{uuid.uuid4().hex}"
    # One file a day: a day holds at most one row per key.
    log.select(*batch.columns).unionByName(fresh).withColumn("day", day).repartition("day").sortWithinPartitions("day", ts).write.partitionBy("day").parquet(folder)
    version = (_versions(spark, log_path) or [0])[-1] + 1
    entries = sorted((now | {d: f"{folder}/day={d}" for d in touched}).items())
    draft = f"{log_path}/drafts/{uuid.uuid4().hex}"
    spark.createDataFrame(entries, "day string, folder string").coalesce(1).write.json(draft)
    path, fs = _fs(spark, log_path)
    fs.mkdirs(path(f"{log_path}/manifests"))
    if not fs.rename(path(draft), path(f"{log_path}/manifests/v{version:09d}")):
        raise OSError("another update has written this version of the log")
    return len(touched)
