import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from lacuna.operators import coast, joint


def km(lon1, lat1, lon2, lat2):
    a, b = np.radians(lat1), np.radians(lat2)
    h = np.sin((b - a) / 2) ** 2 + np.cos(a) * np.cos(b) * np.sin(np.radians(lon2 - lon1) / 2) ** 2
    return 2 * coast.EARTH_KM * np.arcsin(np.sqrt(np.minimum(h, 1)))


@pytest.mark.parametrize(("seed", "around"), [(1, 2048), (2, 16), (3, 2)])
def test_nearest_point_by_brute_force(spark, seed, around):
    """Clusters, the date line, both poles, and sites far from any point."""
    rng = np.random.default_rng(seed)
    points = np.concatenate([rng.normal([20, 45], 0.3, (200, 2)), [[179.9, 10], [-179.95, 10.2], [10, 89.5], [-170, -89.9], [100, -60]], rng.uniform([-180, -90], [180, 90], (30, 2))])
    sites = np.concatenate([rng.normal([20, 45], 0.5, (20, 2)), [[-179.99, 10.1], [179.99, 10.15], [-170, 89.9], [10, 90.0], [10, -90.0], [180.0, 0.0], [-180.0, 0.0]], rng.uniform([-180, -90], [180, 90], (30, 2))])
    p = spark.createDataFrame([(float(a), float(b)) for a, b in points] * 2 + [(None, 1.0)], "lon double, lat double")
    s = spark.createDataFrame([(f"s{i}", float(a), float(b)) for i, (a, b) in enumerate(sites)] + [("none", None, 3.0)], "site string, lon double, lat double")
    got = {r.site: r for r in coast.nearest_point(s, p, around).collect()}
    assert len(got) == len(sites)
    for i, (a, b) in enumerate(sites):
        d = km(a, b, points[:, 0], points[:, 1])
        assert got[f"s{i}"].distance_km == pytest.approx(d.min(), abs=1e-6)
        assert km(a, b, got[f"s{i}"].lon, got[f"s{i}"].lat) == pytest.approx(d.min(), abs=1e-6)


def test_no_points_and_ties(spark):
    s = spark.createDataFrame([("a", 0.0, 0.0)], "site string, lon double, lat double")
    none = spark.createDataFrame([], "lon double, lat double")
    assert coast.nearest_point(s, none).count() == 0
    two = spark.createDataFrame([(1.0, 0.0), (-1.0, 0.0)], "lon double, lat double")
    assert coast.nearest_point(s, two).first().lon == -1.0
    assert coast.nearest_point(s.limit(0), two).count() == 0


def test_attributes_of_sites(spark):
    ring = lambda x: [[x, 0.0], [x + 2, 0.0], [x + 2, 2.0], [x, 2.0]]
    sites = spark.createDataFrame([("a", ring(0.0)), ("b", ring(50.0))], "site string, ring array<array<double>>")
    grid = spark.createDataFrame([(1.0, 1.0, 5.0), (1.0, 1.0, 30.0), (2.0, 2.0, 10.0), (9.0, 9.0, 99.0), (1.5, 1.5, None)], "lat double, lon double, depth double")
    land = spark.createDataFrame([(1.0, 4.0)], "lon double, lat double")
    got = {r.site: r for r in coast.site_attributes(sites, land, grid).collect()}
    assert (got["a"].lon, got["a"].lat, got["a"].depth_m) == (1.0, 1.0, -20.0) and got["b"].depth_m is None
    assert got["a"].distance_km == pytest.approx(km(1, 1, 1, 4)) and got["b"].distance_km == pytest.approx(km(51, 1, 1, 4))


def test_context_variance_is_that_of_all_readings(spark):
    rng = np.random.default_rng(0)
    rows = [(float(a), float(b), float(v), dt.date(2020, 1, 1)) for a, b, v in rng.uniform([0, 0, 0], [2, 2, 9], (300, 3))]
    cells = spark.createDataFrame([*rows, (1.0, 1.0, None, dt.date(2020, 1, 1))], "lat double, lon double, u double, obs_date date")
    boxes = spark.createDataFrame([("a", 0.0, 2.0, 0.0, 2.0)], "site string, lon_min double, lon_max double, lat_min double, lat_max double")
    out = coast.spatial_context(cells, boxes, "u", F.trunc("obs_date", "month")).first()
    assert out.variance == pytest.approx(np.var([r[2] for r in rows])) and out.gradient > 0


def test_context_model_without_rows_or_variation(spark):
    empty = spark.createDataFrame([], "y double, a double")
    assert joint.context_regression(empty, "y", ["a"]).count() == 0
    flat = spark.createDataFrame([(float(i % 3) if i else None, 7.0) for i in range(40)], "y double, a double")
    got = joint.context_regression(flat, "y", ["a"]).filter("y IS NULL").first().filled
    assert got == pytest.approx(np.mean([i % 3 for i in range(1, 40)]))
