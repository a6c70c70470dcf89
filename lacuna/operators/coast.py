"""What does not change about a site: its distance to the coast and the depth around it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.operators.zonal import cells_in_boxes, site_boxes
from lacuna.sources.files import stored

EARTH_KM = 6371.0088


def great_circle(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Kilometres between two points given in degrees."""
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * EARTH_KM) * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def _tile(lon: Column, lat: Column, around: int) -> tuple[Column, Column]:
    """Tile of a point where ``around`` tiles go round the globe."""
    size = 360.0 / around
    return F.pmod(F.floor((lon + 180) / size), F.lit(around)).cast("int"), F.least(F.floor((lat + 90) / size), F.lit(max(around // 2, 1) - 1)).cast("int")


def _safe_km(lon: Column, lat: Column, around: int) -> Column:
    """No point outside the three by three tiles around the point's own is nearer than this."""
    size = 360.0 / around
    row = F.least(F.floor((lat + 90) / size), F.lit(max(around // 2, 1) - 1))
    south, north = (row - 1) * size - 90, (row + 2) * size - 90
    far = F.lit(float("inf"))
    down = F.when(south <= -90, far).otherwise(F.radians(lat - south) * EARTH_KM)
    up = F.when(north >= 90, far).otherwise(F.radians(north - lat) * EARTH_KM)
    if around <= 3:
        return F.least(down, up)
    column = F.floor((lon + 180) / size)
    west, east = (column - 1) * size - 180, (column + 2) * size - 180
    # To a meridian d degrees away; beyond 90 degrees its nearest point is the pole.
    to = lambda d: F.when(d < 90, F.asin(F.cos(F.radians(lat)) * F.sin(F.radians(d)))).otherwise(F.radians(F.lit(90.0) - F.abs(lat))) * EARTH_KM
    return F.least(down, up, to(lon - west), to(east - lon))


def nearest_point(sites: DataFrame, points: DataFrame, around: int = 2048) -> DataFrame:
    """(site, distance_km, lon, lat): for each of ``sites`` (site, lon, lat) the nearest of ``points`` (lon, lat), exactly.

    Sites and points meet in tiles, a site in its own and the eight around it, by an equality join.
    A site is settled once its nearest hit lies within what the nine tiles cover; only the others
    go on to tiles of twice the size, up to the whole globe. Ties go to the smaller lon, lat.
    Sites or points without a place take no part; without points there are no rows.
    """
    placed = lambda df: df.filter(F.col("lon").isNotNull() & F.col("lat").isNotNull())
    spark = sites.sparkSession
    coast = stored(spark, placed(points).select("lon", "lat").distinct(), "coast")
    open_ = stored(spark, placed(sites).select("site", "lon", "lat"), "open")
    settled = None
    while True:
        tx, ty = _tile(F.col("lon"), F.col("lat"), around)
        shifts = F.array(*[F.lit(k) for k in (-1, 0, 1)])
        own = open_.withColumn("_tx", tx).withColumn("_ty", ty)
        own = own.withColumn("_dx", F.explode(shifts)).withColumn("_dy", F.explode(shifts))
        own = own.withColumn("_tx", F.pmod(F.col("_tx") + F.col("_dx"), F.lit(around))).withColumn("_ty", F.col("_ty") + F.col("_dy"))
        # With few tiles around, two shifts may name one tile.
        own = own.select("site", "lon", "lat", "_tx", "_ty").distinct()
        cx, cy = _tile(F.col("c_lon"), F.col("c_lat"), around)
        tiles = coast.select(F.col("lon").alias("c_lon"), F.col("lat").alias("c_lat")).withColumn("_tx", cx).withColumn("_ty", cy)
        km = great_circle(F.col("lon"), F.col("lat"), F.col("c_lon"), F.col("c_lat"))
        best = own.join(tiles, ["_tx", "_ty"]).groupBy("site", "lon", "lat").agg(F.min(F.struct(km.alias("distance_km"), F.col("c_lon").alias("lon"), F.col("c_lat").alias("lat"))).alias("hit"))
        last = around <= 2
        sure = F.col("hit.distance_km") <= (F.lit(float("inf")) if last else _safe_km(F.col("lon"), F.col("lat"), around))
        tried = stored(spark, open_.join(best, ["site", "lon", "lat"], "left").withColumn("sure", F.coalesce(sure, F.lit(last))), "tried")
        done = tried.filter("sure AND hit IS NOT NULL").select("site", "hit.*")
        settled = done if settled is None else settled.unionByName(done)
        open_ = tried.filter("NOT sure").select("site", "lon", "lat")
        if last or open_.limit(1).count() == 0:
            return settled
        around //= 2


def site_attributes(sites: DataFrame, points: DataFrame, grid: DataFrame) -> DataFrame:
    """site, lon, lat (middle of its box), distance_km to the nearest of the coast's ``points``, and
    depth_m, below sea level negative: the mean over the box's grid points of the deepest level with a reading.

    ``grid`` has lat, lon, depth of readings. A box without readings has a null depth.
    """
    boxes = site_boxes(sites)
    middle = boxes.select("site", ((F.col("lon_min") + F.col("lon_max")) / 2).alias("lon"), ((F.col("lat_min") + F.col("lat_max")) / 2).alias("lat"))
    deepest = grid.filter(F.col("depth").isNotNull()).groupBy("lat", "lon").agg(F.max("depth").alias("depth"))
    depth = cells_in_boxes(deepest, boxes).groupBy("site").agg((-F.avg("depth")).alias("depth_m"))
    near = nearest_point(middle, points).select("site", "distance_km")
    return middle.join(near, "site", "left").join(depth, "site", "left")


def spatial_context(cells: DataFrame, boxes: DataFrame, value: str, period: Column, cell_deg: float = 0.5) -> DataFrame:
    """(site, period, gradient, variance) of a gridded value inside each box and period.

    The gradient is that of the means of square cells of ``cell_deg``, the variance that of all readings.
    """
    from lacuna.operators.zonal import spatial_gradient

    kept = cells.select("lat", "lon", value, period.alias("period"))
    inside = cells_in_boxes(kept, boxes).filter(F.col(value).isNotNull())
    square = lambda c: F.floor(F.col(c) / cell_deg).cast("int").alias(c)
    parts = inside.groupBy("site", "period", square("lat"), square("lon")).agg(
        F.avg(value).alias("v"), F.count(F.lit(1)).alias("n"), F.var_pop(value).alias("s")
    )
    # The variance of the whole from that of its squares: within plus between.
    whole = F.sum("n")
    mean = F.sum(F.col("n") * F.col("v")) / whole
    spread = F.sum(F.col("n") * (F.col("s") + F.col("v") * F.col("v"))) / whole - mean * mean
    slope = spatial_gradient(parts, ["site", "period"], "v").select("site", "period", "gradient")
    return slope.join(parts.groupBy("site", "period").agg(spread.alias("variance")), ["site", "period"])


CONTEXT: Sequence[str] = ("gradient", "variance", "distance_km", "depth_m")
