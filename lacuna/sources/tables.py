"""The driver tables, and the panels that Spark derives from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VARIABLES = ("balance", "n_orders", "total")
SHIP_VARIABLES = ("discount", "price", "quantity", "tax")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table, with the schema it has now."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nan_to_null(df: DataFrame) -> DataFrame:
    """NULL is the only missing value past a source; Spark's avg and max treat NaN as data."""
    doubles = {f.name for f in df.schema.fields if f.dataType.simpleString() in ("double", "float")}
    return df.select(
        *[F.when(~F.isnan(c), F.col(c)).alias(c) if c in doubles else F.col(c) for c in df.columns]
    )


def money(col: str) -> Column:
    return F.sum(F.col(col).cast("decimal(18,2)")).cast("double")


def orders_by_place(spark: SparkSession, sf_dir: str, level: str) -> DataFrame:
    """Orders with their nation or region as ``location``.

    Only the places, a dimension, are hinted: customers are estimated by the size of their files and
    would go through the driver in their stead. Adaptive execution measures orders and customers, and splits skewed
    partitions (a customer may own a third of all orders).
    """
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority",
        F.to_date("o_orderdate").alias("obs_date"),
    )
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    nation = table(spark, sf_dir, "nation")
    places = nation.select(F.col("n_nationkey"), F.col("n_name").alias("location"))
    if level == "region":
        region = table(spark, sf_dir, "region")
        places = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
            "n_nationkey", F.col("r_name").alias("location")
        )
    placed = customer.join(F.broadcast(places), F.col("c_nationkey") == F.col("n_nationkey"))
    return orders.join(placed, F.col("o_custkey") == F.col("c_custkey"))


def orders_panel(spark: SparkSession, sf_dir: str, level: str = "nation") -> DataFrame:
    """(location, obs_date) -> total (thousands), n_orders, balance.

    One row per location and day: whatever the raw skew, a location ends with at
    most one row per calendar day, reached by map-side partial sums.
    """
    return (
        orders_by_place(spark, sf_dir, level)
        .groupBy("location", "obs_date")
        .agg(
            (money("c_acctbal") / F.count(F.lit(1))).alias("balance"),
            F.count(F.lit(1)).cast("double").alias("n_orders"),
            (money("o_totalprice") / F.lit(1000.0)).alias("total"),
        )
    )


def ship_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(location = return flag, obs_date = ship date) -> four variables."""
    items = table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("location"), F.to_date("l_shipdate").alias("obs_date"),
        "l_quantity", "l_extendedprice", "l_discount", "l_tax",
    )
    return items.groupBy("location", "obs_date").agg(
        (money("l_discount") / F.count(F.lit(1))).alias("discount"),
        (money("l_extendedprice") / F.lit(1000.0)).alias("price"),
        money("l_quantity").alias("quantity"),
        (money("l_tax") / F.count(F.lit(1))).alias("tax"),
    )


def urgent_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(location, obs_date) -> share of urgent orders, the event label of the panel."""
    urgent = F.when(F.col("o_orderpriority") == "1-URGENT", 1).otherwise(0)
    return orders_by_place(spark, sf_dir, "nation").groupBy("location", "obs_date").agg(
        (F.sum(urgent).cast("double") / F.count(F.lit(1))).alias("label")
    )


def hourly_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return events.groupBy(
        F.col("event_type").alias("location"), F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("obs_hour")
    ).agg(money("value").alias("value"), F.count(F.lit(1)).alias("n_events"))


def daily_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return events.groupBy(F.col("event_type").alias("location"), F.to_date("ts").alias("obs_date")).agg(
        money("value").alias("value"), F.count(F.lit(1)).alias("n_events")
    )


def grid_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A gridded field: line items on a 10 x 10 degree grid, with depth and two values.

    Line number 7 stands for land: its readings are missing.
    """
    items = table(spark, sf_dir, "lineitem")
    land = F.col("l_linenumber") == 7
    return items.select(
        ((F.col("l_partkey") % 100) / F.lit(10.0)).alias("lat"),
        ((F.col("l_suppkey") % 100) / F.lit(10.0)).alias("lon"),
        F.col("l_linenumber").cast("double").alias("depth"),
        F.to_date("l_shipdate").alias("obs_date"),
        F.when(~land, F.col("l_quantity")).alias("u"),
        F.when(~land, F.col("l_extendedprice") / F.lit(1000.0)).alias("v"),
        F.col("l_orderkey").alias("scene"),
        F.col("l_partkey").alias("qa"),
        (F.col("l_discount") * 400).alias("cloud_pct"),
    )


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One box per region, written as a closed polygon ring of [lon, lat] points."""
    k = F.col("r_regionkey")
    west, south = (k * 2).cast("double"), (k * F.lit(1.5))
    east, north = west + 1.5, south + 2.0
    ring = F.array(
        F.array(west, south), F.array(east, south), F.array(east, north), F.array(west, north), F.array(west, south)
    )
    return table(spark, sf_dir, "region").select(F.col("r_name").alias("site"), ring.alias("ring"))


def donors(spark: SparkSession, sf_dir: str, level: str = "region", per_target: int = 1) -> DataFrame:
    """Reference sites: each target borrows from the next ``per_target`` keys, cyclically.

    Bounded by construction at ``per_target`` rows per location.
    """
    t, k, name = ("region", "r_regionkey", "r_name") if level == "region" else ("nation", "n_nationkey", "n_name")
    base = table(spark, sf_dir, t).select(F.col(k).alias("k"), F.col(name).alias("name"))
    size = base.select(F.count(F.lit(1)).cast("int")).scalar()
    steps = F.explode(F.sequence(F.lit(1), F.lit(per_target))).alias("step")
    want = base.select(F.col("name").alias("target"), "k", steps).select(
        "target", "step", ((F.col("k") + F.col("step")) % size).alias("k")
    )
    return want.join(base, "k").select(
        "target", F.col("name").alias("donor"), (F.lit(50.0) * F.col("step")).alias("distance_km")
    )


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model probabilities per labelled document, in the long form (sample, model, prob).

    Four models, six splits; one probability in nine of model ``gru`` is missing and
    ``transformer`` has none in split 5.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    d, n = F.col("doc_id"), F.col("n_chars")
    wide = table(spark, sf_dir, "labels").join(docs, "doc_id").select(
        d.alias("sample_id"), (d % 6).cast("int").alias("split_num"), F.col("quality").alias("label"),
        (((n + d * 7) % 1000) / F.lit(1000.0) * 0.6 + F.col("quality") * 0.3).alias("lstm"),
        F.when(d % 9 != 0, ((n * 3 + d * 11) % 997) / F.lit(997.0)).alias("gru"),
        F.when(d % 6 != 5, ((n + d) % 500) / F.lit(500.0) * 0.5 + F.col("toxic") * 0.4).alias("transformer"),
        (((n * 13 + d) % 101) / F.lit(101.0)).alias("xgboost"),
    )
    return wide.unpivot(
        ["sample_id", "split_num", "label"], ["lstm", "gru", "transformer", "xgboost"], "model", "prob"
    )
