"""From gridded cells to one series per site."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Dimension spellings and the kilometres of one degree.
DIMENSION_ALIASES = {
    "lat": ("latitude", "lat", "nav_lat", "y"),
    "lon": ("longitude", "lon", "nav_lon", "x"),
    "depth": ("depth", "deptho", "lev", "z"),
}
KM_PER_DEGREE = 111.0


def canonical_dimensions(df: DataFrame) -> DataFrame:
    """Rename whichever spelling of a dimension the source uses."""
    have = {c.lower(): c for c in df.columns}
    found = {}
    for name, spellings in DIMENSION_ALIASES.items():
        hit = next((have[s] for s in spellings if s in have), None)
        if hit and hit != name:
            found[hit] = name
    return df.withColumnsRenamed(found)


def site_boxes(sites: DataFrame, buffer_deg: float = 0.0, buffer_m: float = 0.0) -> DataFrame:
    """Bounding box of each site's ring, optionally widened in degrees or metres, and its
    area in km2 with no correction for latitude."""
    pad = F.lit(float(buffer_deg + buffer_m / (KM_PER_DEGREE * 1000)))
    lon = F.transform("ring", lambda p: p[0])
    lat = F.transform("ring", lambda p: p[1])
    box = sites.select(
        "site",
        (F.array_min(lon) - pad).alias("lon_min"), (F.array_max(lon) + pad).alias("lon_max"),
        (F.array_min(lat) - pad).alias("lat_min"), (F.array_max(lat) + pad).alias("lat_max"),
    )
    area = (F.col("lon_max") - F.col("lon_min")) * (F.col("lat_max") - F.col("lat_min")) * F.lit(KM_PER_DEGREE**2)
    return box.withColumn("area_km2", area)


def cells_in_boxes(cells: DataFrame, boxes: DataFrame, tile_deg: float = 1.0) -> DataFrame:
    """Cells inside each box, bounds included.

    Boxes are cut into tiles of ``tile_deg`` and joined on the tile, so the join is an
    equality however many sites there are; the exact bounds are checked on the hits.
    Cells are narrowed to the columns in use and pre-aggregation can follow directly.
    """
    tile = lambda c: F.floor(F.col(c) / tile_deg).cast("int")
    tiles = boxes.withColumn("_ty", F.explode(F.sequence(tile("lat_min"), tile("lat_max")))).withColumn(
        "_tx", F.explode(F.sequence(tile("lon_min"), tile("lon_max")))
    )
    placed = cells.withColumn("_ty", tile("lat")).withColumn("_tx", tile("lon"))
    inside = F.col("lat").between(F.col("lat_min"), F.col("lat_max")) & F.col("lon").between(
        F.col("lon_min"), F.col("lon_max")
    )
    return placed.join(tiles, ["_ty", "_tx"]).filter(inside).select(*cells.columns, "site")


def surface(cells: DataFrame, value: str, keys: Sequence[str], band: tuple[float, float] | None = None) -> DataFrame:
    """Value at the shallowest level that has one, within an optional depth band."""
    seen = cells.filter(F.col(value).isNotNull())
    if band:
        seen = seen.filter(F.col("depth").between(*band))
    return seen.groupBy(*keys).agg(
        F.min("depth").alias("depth"), F.min_by(value, F.struct("depth", value)).alias(value)
    )


def zonal_mean(cells: DataFrame, boxes: DataFrame, values: Sequence[str]) -> DataFrame:
    """Daily mean over a site's cells; missing (land) cells do not count.

    The grid point is aggregated before the sites are met: a point with a third of all
    readings enters the join as one row per day.
    """
    sums = [a for v in values for a in (F.sum(v).alias(f"s_{v}"), F.count(v).alias(f"n_{v}"))]
    points = cells.groupBy("lat", "lon", "obs_date").agg(*sums)
    hit = cells_in_boxes(points, boxes)
    return hit.groupBy("site", "obs_date").agg(
        *[F.try_divide(F.sum(f"s_{v}"), F.sum(f"n_{v}")).alias(v) for v in values]
    )


def wind_speed(cells: DataFrame, keys: Sequence[str], mode: str = "per_cell") -> DataFrame:
    """``per_cell``: mean of each cell's speed. ``of_means``: speed of the mean vector,
    which is smaller whenever directions differ."""
    u, v = F.col("u"), F.col("v")
    both = cells.filter(u.isNotNull() & v.isNotNull())
    speed = F.avg(F.sqrt(u * u + v * v)) if mode == "per_cell" else F.sqrt(F.avg(u) * F.avg(u) + F.avg(v) * F.avg(v))
    return both.groupBy(*keys).agg(speed.alias("wind_speed"))


def ndvi(cells: DataFrame, keys: Sequence[str], nir: Column, red: Column, cloud: Column, qa: Column, max_cloud: float = 30.0) -> DataFrame:
    """Mean vegetation index over clear pixels of scenes with little cloud."""
    from lacuna.functions.expr import clear_sky, normalised_difference

    good = cells.filter((cloud < max_cloud) & clear_sky(qa))
    return good.groupBy(*keys).agg(F.avg(normalised_difference(nir, red)).alias("ndvi"))


def spatial_variance(cells: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    return cells.groupBy(*keys).agg(F.var_pop(value).alias("variance"))


def spatial_gradient(grid: DataFrame, keys: Sequence[str], value: str, row: str = "lat", col: str = "lon") -> DataFrame:
    """Magnitude of the mean gradient vector of a grid: central differences inside,
    one-sided at the edges, unit spacing.

    ``grid`` has one value per (keys, row, col); windows run along one row or column of
    one grid at a time.
    """
    def slope(across: str, along: str) -> Column:
        w = Window.partitionBy(*keys, across).orderBy(along)
        before, here, after = F.lag(value).over(w), F.col(value), F.lead(value).over(w)
        first, last = F.lag(F.lit(1)).over(w).isNull(), F.lead(F.lit(1)).over(w).isNull()
        return F.when(first & last, F.lit(None)).when(first, after - here).when(last, here - before).otherwise(
            (after - before) / 2
        )

    g = grid.withColumn("_gx", slope(row, col)).withColumn("_gy", slope(col, row))
    gx, gy = F.avg("_gx"), F.avg("_gy")
    return g.groupBy(*keys).agg(
        gx.alias("grad_x"), gy.alias("grad_y"), F.sqrt(gx * gx + gy * gy).alias("gradient")
    )
