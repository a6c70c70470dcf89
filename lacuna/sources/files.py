"""Readers and writers of panels, masked data sets, forecasts and site geometry."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lacuna.functions.expr import lenient_date, lenient_number
from lacuna.sources.tables import nan_to_null


def panel_schema(variables: Sequence[str]) -> T.StructType:
    fields = [T.StructField("location", T.StringType()), T.StructField("obs_date", T.DateType())]
    return T.StructType(fields + [T.StructField(v, T.DoubleType()) for v in variables])


def read_panel_csv(spark: SparkSession, path: str, variables: Sequence[str]) -> DataFrame:
    """Panel CSV with an explicit schema; empty and NaN become NULL."""
    reader = spark.read.option("header", True).option("dateFormat", "yyyy-MM-dd").schema(panel_schema(variables))
    return nan_to_null(reader.csv(path))


def lenient(df: DataFrame, date: str, numbers: Sequence[str], default: float | None = 0.0) -> DataFrame:
    """Text columns to a date and numbers: rows with an unreadable date go, an unreadable
    number takes the default."""
    cols = []
    for c in df.columns:
        if c == date:
            cols.append(lenient_date(F.col(c)).alias(c))
        elif c in numbers:
            cols.append(lenient_number(F.col(c), default).alias(c))
        else:
            cols.append(F.col(c))
    return df.select(*cols).dropna(subset=[date])


def write_masked(cells: DataFrame, path: str) -> None:
    """Masked data sets, one directory per strategy and split, readers prune by both."""
    cells.write.mode("overwrite").partitionBy("mask_type", "split_num").parquet(path)


def read_masked(spark: SparkSession, path: str, mask_type: str | None = None, split_num: int | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    if mask_type is not None:
        df = df.filter(F.col("mask_type") == mask_type)
    if split_num is not None:
        df = df.filter(F.col("split_num") == split_num)
    return df


def write_results(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)


def write_forecasts(documents: DataFrame, path: str) -> None:
    """Nested JSON, one directory per run date. A rerun replaces its own day only."""
    documents.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_date").json(path)


def latest_snapshot(df: DataFrame, run_date: str = "run_date") -> DataFrame:
    """Rows of the newest run, by date and never by file time."""
    newest = df.select(F.max(run_date)).scalar()
    return df.filter(F.col(run_date) == newest)


FEATURES = (
    "struct<type:string,features:array<struct<"
    "properties:map<string,string>,geometry:struct<type:string,coordinates:string>>>>"
)


def parse_geojson(df: DataFrame, text: str = "text") -> DataFrame:
    """One row per feature: site name (``Name`` or ``name``) and outer ring of [lon, lat] points.

    A point is a ring of one point, so that its box is the point itself; a geometry of
    another kind has no ring.
    """
    return _sites(df.select(F.explode(F.from_json(text, FEATURES).features).alias("f")))


def _sites(features: DataFrame) -> DataFrame:
    kind, place = F.col("f.geometry.type"), F.col("f.geometry.coordinates")
    polygon = F.get(F.from_json(place, "array<array<array<double>>>"), 0)
    ring = F.when(kind == "Polygon", polygon).when(kind == "Point", F.array(F.from_json(place, "array<double>")))
    properties = F.col("f.properties")
    return features.select(F.coalesce(properties.getItem("Name"), properties.getItem("name")).alias("site"), ring.alias("ring"))


ONE_FEATURE = "struct<properties:map<string,string>,geometry:struct<type:string,coordinates:string>>"


def read_geojson_features(spark: SparkSession, path: str) -> DataFrame:
    """As :func:`read_geojson`, for collections of any size: a file is read by as many tasks as it has splits.

    The text is cut at the value ``"Feature"``, with which writers begin a feature
    (``{"type": "Feature", ...``); quotes inside strings are escaped, so no other text cuts it but a
    property that is this very word. What follows up to the next one is the rest of a feature, then
    the beginning of another that the parser leaves unread. A feature whose type
    does not come first has no properties and no ring.
    """
    pieces = spark.read.option("lineSep", '"Feature"').text(path).select(F.ltrim("value").alias("rest"))
    # The head of a collection, before its first feature, opens an object.
    rest = pieces.filter(F.col("rest").startswith(",") | F.col("rest").startswith("}"))
    # Without the comma the rest is the inside of an object.
    f = F.from_json(F.concat(F.lit("{"), F.regexp_replace("rest", r"^,", "")), ONE_FEATURE).alias("f")
    return _sites(rest.select(f))


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """Feature collections, one per file."""
    return parse_geojson(spark.read.text(path, wholetext=True).withColumnRenamed("value", "text"))


def stored(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: for a panel that several
    branches of a plan need, so that the raw tables are scanned once and a lost
    executor costs no recomputation."""
    from lacuna.session import fresh_path

    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.parquet(path)


def join_stats(df: DataFrame, stats: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join a table of statistics on keys that take few values (variable, model, split).

    Shuffling ``df`` on such a key would pile it up on a few reducers. The statistics are
    written first, so the planner knows their true size: within the session's broadcast
    threshold ``df`` stays where it is, beyond it the join is sorted and adaptive
    execution splits the heavy partitions.
    """
    return df.join(stored(df.sparkSession, stats, "stats"), list(keys), how)
