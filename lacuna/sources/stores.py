"""The fact and dimension tables: loads that change nothing when run twice."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.functions.scan import hash_rank

# Panel variable -> fact column.
HISTORY_FIELDS = {"thetao": "sst", "CHL": "chlorophyll_a_proxy", "precip_mm_day": "rainfall_mm", "so": "salinity"}


def new_locations(names: DataFrame, dimension: DataFrame) -> DataFrame:
    """Names the dimension does not hold yet, with ids following its greatest one, in the
    order of the names' md5: dense, repeatable, and numbered without one big sort."""
    fresh = names.select("location_name").distinct().join(dimension, "location_name", "left_anti")
    top = dimension.select(F.coalesce(F.max("location_id"), F.lit(0))).scalar()
    keyed = fresh.withColumn("_h", F.md5("location_name")).withColumn("_g", F.lit(0))
    ranked = hash_rank(keyed, ["_g"], "_h", digits=2)
    return ranked.select((F.col("_rank") + top).cast("int").alias("location_id"), "location_name")


def history_rows(
    panel: DataFrame, dimension: DataFrame, fields: dict[str, str] = HISTORY_FIELDS, label: str = "label",
    threshold: float = 0.0, inclusive: bool = False,
) -> DataFrame:
    """Fact rows of known sites: the label as a flag (above 0; another loader uses >= 1)
    and the renamed variables. Unknown sites are left out."""
    hit = F.col(label) >= threshold if inclusive else F.col(label) > threshold
    return panel.join(dimension, F.col("location") == F.col("location_name")).select(
        "location_id", F.col("obs_date").alias("date"), F.coalesce(hit, F.lit(False)).alias("redtide_present"),
        *[F.col(src).alias(dst) for src, dst in fields.items()],
    )


def new_predictions(batch: DataFrame, log: DataFrame, keys: Sequence[str] = ("location_id",), ts: str = "prediction_timestamp") -> DataFrame:
    """At most one prediction per site and calendar day: the earliest of the batch, unless
    the log has one already."""
    day = F.to_date(ts).alias("_day")
    rest = [c for c in batch.columns if c not in keys]
    one = batch.groupBy(*keys, day).agg(F.min_by(F.struct(*rest), F.col(ts)).alias("_row"))
    have = log.select(*keys, day).distinct()
    return one.join(have, [*keys, "_day"], "left_anti").select(*keys, *[f"_row.{c}" for c in rest])
