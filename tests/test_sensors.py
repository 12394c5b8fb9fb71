"""Sensor models sampled: boundary order, gaps, rays that miss, covariance."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from veldspar.functions.geometry import RADIUS_M
from veldspar.operators import sensors

POSES = "model_id string, line double, x double, y double, z double, bx double, by double, bz double, ax double, ay double, az double, middle double, attitude_source string, covariance_m2 double"
HIGH = RADIUS_M + 1e5


def _poses(spark, lines, covariance=4.0, down=-1.0):
    return spark.createDataFrame([("m", float(i), HIGH, 0.0, 10.0 * i, down, 0.0, 0.0, 0.0, 1e-4, 0.0, 5.0, "track", covariance) for i in lines], POSES)


def _pixels(spark, places):
    return spark.createDataFrame([("m", float(a), float(b)) for a, b in places], "model_id string, line double, sample double")


def test_boundary_order(spark):
    got = spark.range(1).select(sensors.boundary_pixels(F.lit(5), F.lit(9), 3).alias("b")).first()["b"]
    assert [tuple(p) for p in got] == [(0, 0), (0, 4), (0, 8), (2, 8), (4, 8), (4, 4), (4, 0), (2, 0)]
    two = spark.range(1).select(sensors.boundary_pixels(F.lit(5), F.lit(9), 2).alias("b")).first()["b"]
    assert [tuple(p) for p in two] == [(0, 0), (0, 8), (4, 8), (4, 0)]
    with pytest.raises(ValueError):
        sensors.boundary_pixels(F.lit(5), F.lit(9), 1)


def test_poses_between_their_neighbours_only(spark):
    poses = _poses(spark, [0, 10, 300, 310])
    at = lambda most: {r["line"]: r["z"] for r in sensors.poses_at(_pixels(spark, [(x, 5) for x in (-1, 0, 5, 10, 155, 255.5, 256, 300, 310, 311)]), poses, most).collect()}
    wide = at(1e6)
    assert wide[-1.0] is None and wide[311.0] is None and wide[5.0] == 50 and wide[310.0] == 3100 and wide[155.0] == pytest.approx(1550) and wide[256.0] == pytest.approx(2560)
    narrow = at(20)
    assert narrow[155.0] is None and narrow[256.0] is None and narrow[10.0] == 100 and narrow[300.0] == 3000 and narrow[5.0] == 50


def test_poses_of_pixels_whose_order_varies(spark):
    """Each evaluation of the pixels deals their rows anew, as a shuffle may."""

    def dealt(batches):
        for b in batches:
            yield b.sample(frac=1)

    rows = _pixels(spark, [(x / 4, 5) for x in range(400)]).coalesce(1).mapInPandas(dealt, "model_id string, line double, sample double")
    got = {r["line"]: r["z"] for r in sensors.poses_at(rows, _poses(spark, range(0, 110, 10))).collect()}
    assert len(got) == 400 and all(z == pytest.approx(10 * line) for line, z in got.items())


def test_rays_and_geometry(spark):
    ground = sensors.ground_at(_pixels(spark, [(0, 5)]), _poses(spark, [0])).first()
    assert ground["latitude_deg"] == 0 and ground["longitude_deg"] == 0
    away = sensors.ground_at(_pixels(spark, [(0, 5)]), _poses(spark, [0], down=1.0)).first()
    wide = sensors.ground_at(_pixels(spark, [(0, 1e5)]), _poses(spark, [0])).first()
    assert away["latitude_deg"] is None and wide["longitude_deg"] is None and wide["x"] == HIGH
    pixels = _pixels(spark, [(0, 5)]).withColumn("pixel_id", F.lit(1))
    g = sensors.sample_local_geometry(pixels, _poses(spark, [0, 1])).first()
    assert g["status"] == "ok" and g["gsd_sample_m"] == pytest.approx(10.0, rel=1e-3) and g["gsd_line_m"] == pytest.approx(10.0, rel=1e-3) and g["view_zenith_deg"] == pytest.approx(0, abs=1e-5) and g["geometry_uncertainty_deg"] == pytest.approx(0.0011459, rel=1e-3)
    bare = sensors.sample_local_geometry(pixels, _poses(spark, [0, 1], None)).first()
    assert bare["gsd_line_m"] is not None and bare["view_zenith_deg"] is None and bare["geometry_uncertainty_deg"] is None
    assert sensors.sample_local_geometry(pixels, _poses(spark, [0])).first()["status"] == "ground_unavailable"


def test_footprints_over_the_date_line(spark):
    turned = _poses(spark, [0, 10]).withColumns({"x": -F.col("x"), "bx": -F.col("bx")})
    images = spark.createDataFrame([("m", 11, 11), ("other", 11, 11)], "model_id string, rows int, columns int")
    got = {r["model_id"]: r for r in sensors.sample_footprints(images, turned, 3, (1, 1)).collect()}
    m = got["m"]
    assert m["status"] == "ok" and abs(abs(m["longitude_anchor_deg"]) - 180) < 1e-6 and m["lon_high"] - m["lon_low"] < 0.01 and len(m["boundary"]) == 8 and len(m["interior"]) == 1 and not m["is_polar"]
    assert got["other"]["status"] == "boundary_unavailable" and got["other"]["boundary"] is None
    assert sensors.sample_footprints(images.limit(0), turned).count() == 0
