"""Queries of sensor models sampled: a model a supplier, on a planted track over the sphere, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from veldspar.operators import sensors
from veldspar.plans.registry import _r, _t, query

#: A pose every ten lines up to line 60, 100 km high, looking down; a sample turns the view by a fifth of a milliradian to the east. Every eleventh image is longer than its track.
_MODEL = "s_suppkey AS model_id, (s_suppkey % 160) - 80.0e0 AS lat0, (s_suppkey * 37 % 360) - 180.0e0 AS lon0, CASE WHEN s_suppkey % 11 = 0 THEN 80 ELSE 61 END AS n_rows, 41 AS n_columns, CASE WHEN s_suppkey % 3 > 0 THEN 25.0e0 END AS covariance_m2"
_HEIGHT, _TURN = 1837400.0, 2e-4


def _posed(spark, d):
    """Images and poses."""
    m = _t(spark, d, "supplier").selectExpr(*_MODEL.replace("e0", "D").split(", "))
    lat, lon = F.radians(F.col("lat0") + F.col("line") * 0.01), F.radians("lon0")
    down = (F.cos(lat) * F.cos(lon), F.cos(lat) * F.sin(lon), F.sin(lat))
    rows = m.withColumn("line", F.explode(F.transform(F.sequence(F.lit(0), F.lit(6)), lambda i: i * 10.0)))
    side = (-F.sin(lon) * _TURN, F.cos(lon) * _TURN, F.lit(0.0))
    poses = rows.select("model_id", "line", *((_HEIGHT * v).alias(k) for k, v in zip("xyz", down, strict=True)), *((-v).alias(f"b{k}") for k, v in zip("xyz", down, strict=True)), *(v.alias(f"a{k}") for k, v in zip("xyz", side, strict=True)), F.lit(20.0).alias("middle"), F.lit("track").alias("attitude_source"), "covariance_m2")
    return m.select("model_id", F.col("n_rows").alias("rows"), F.col("n_columns").alias("columns")), poses


def _ground_sql(pixels: str) -> str:
    """SQL of g: the rows of `pixels` (model_id, line, sample and others) with px, py, pz and lat, lon, null beyond the track."""
    at = lambda f: f"CASE WHEN line BETWEEN 0 AND 60 THEN (1 - t) * {f.format('la')} + t * {f.format('lb')} END"
    n = {"x": "cos({0}) * cos(radians(lon0))", "y": "cos({0}) * sin(radians(lon0))", "z": "sin({0})"}
    side = {"x": "-sin(radians(lon0))", "y": "cos(radians(lon0))", "z": "0"}
    return f"""g0 AS (SELECT p.*, m.lat0, m.lon0, m.covariance_m2, line / 10 - floor(line / 10) AS t, radians(lat0 + floor(line / 10) * 10 * 0.01e0) AS la, radians(lat0 + (floor(line / 10) * 10 + 10) * 0.01e0) AS lb FROM {pixels} p JOIN m ON m.model_id = p.model_id),
    g1 AS (SELECT *, {', '.join(f"{at(v)} AS n{k}" for k, v in n.items())} FROM g0), g2 AS (SELECT *, {', '.join(f"{_HEIGHT}e0 * n{k} AS p{k}, -n{k} + (sample - 20) * {_TURN:.4f}e0 * ({side[k]}) AS d{k}" for k in "xyz")} FROM g1),
    g3 AS (SELECT *, dx * dx + dy * dy + dz * dz AS dd, px * dx + py * dy + pz * dz AS pd, px * px + py * py + pz * pz - 1737400.0e0 * 1737400.0e0 AS pp FROM g2), g4 AS (SELECT *, (-pd - sqrt(greatest(0, pd * pd - dd * pp))) / dd AS s FROM g3),
    g AS (SELECT * EXCLUDE (s), CASE WHEN s IS NOT NULL THEN degrees(asin(greatest(-1, least(1, (pz + s * dz) / 1737400.0e0)))) END AS lat, degrees(atan2(py + s * dy, px + s * dx)) AS lon FROM g4)"""


_M = f"m AS (SELECT {_MODEL} FROM supplier)"
_PIXELS = "SELECT l_orderkey * 10 + l_linenumber AS pixel_id, min(l_suppkey) AS model_id, min(l_partkey % 700) / 10.0e0 AS line, min(l_orderkey % 410) / 10.0e0 AS sample FROM lineitem GROUP BY 1"


def _pixels(spark, d):
    _t(spark, d, "lineitem").createOrReplaceTempView("sensed_items")
    return spark.sql(_PIXELS.replace("e0", "D").replace("FROM lineitem", "FROM sensed_items"))


@query(f"WITH {_M}, q AS ({_PIXELS}), {_ground_sql('q')} SELECT pixel_id, model_id, px IS NOT NULL AS posed, round(lat, 7) AS latitude_deg, round(lon, 6) AS longitude_deg FROM g")
def ground_points(spark, d):
    """Poses interpolated between their neighbours; lines after the last pose have none."""
    _, poses = _posed(spark, d)
    rows = sensors.ground_at(_pixels(spark, d), poses)
    return rows.select("pixel_id", "model_id", F.col("x").isNotNull().alias("posed"), _r(F.col("latitude_deg"), 7).alias("latitude_deg"), _r(F.col("longitude_deg")).alias("longitude_deg"))


_EDGE = """x AS (SELECT model_id, n_rows, n_columns, unnest(range(9)) AS i FROM m), e AS (SELECT model_id, 0.0e0 AS line, i * (n_columns - 1) / 8.0e0 AS sample FROM x UNION ALL SELECT model_id, i * (n_rows - 1) / 8.0e0, n_columns - 1.0e0 FROM x WHERE i > 0
    UNION ALL SELECT model_id, n_rows - 1.0e0, i * (n_columns - 1) / 8.0e0 FROM x WHERE i < 8 UNION ALL SELECT model_id, i * (n_rows - 1) / 8.0e0, 0.0e0 FROM x WHERE i BETWEEN 1 AND 7),
    n AS (SELECT model_id, a.i * (n_rows - 1) / 4.0e0 AS line, b.i * (n_columns - 1) / 4.0e0 AS sample FROM m, range(1, 4) a(i), range(1, 4) b(i)), q AS (SELECT *, true AS edge FROM e UNION ALL SELECT *, false FROM n)"""


@query(f"""WITH {_M}, {_EDGE}, {_ground_sql('q')}, c AS (SELECT model_id, degrees(atan2(sum(sin(radians(lon))), sum(cos(radians(lon))))) AS mid, count(*) FILTER (edge AND lat IS NULL) > 0 AS lost FROM g GROUP BY 1),
    u AS (SELECT g.model_id, lost, edge, lat, mid + ((lon - mid + 540) % 360) - 180 AS lon FROM g JOIN c ON c.model_id = g.model_id), a AS (SELECT model_id, avg(lon) AS anchor FROM u GROUP BY 1)
    SELECT u.model_id, CASE WHEN lost THEN 'boundary_unavailable' ELSE 'ok' END AS status, CASE WHEN NOT lost THEN 32 END AS boundary_points, CASE WHEN NOT lost THEN 9 END AS interior_points, CASE WHEN NOT lost THEN round(max(anchor), 6) END AS longitude_anchor_deg, CASE WHEN NOT lost THEN round(min(lat), 7) END AS lat_low,
    CASE WHEN NOT lost THEN round(max(lat), 7) END AS lat_high, CASE WHEN NOT lost THEN round(min(lon) FILTER (edge), 6) END AS lon_low, CASE WHEN NOT lost THEN round(max(lon) FILTER (edge), 6) END AS lon_high, CASE WHEN NOT lost THEN bool_or(abs(lat) >= 85) END AS is_polar FROM u JOIN a ON a.model_id = u.model_id GROUP BY u.model_id, lost""")
def footprints_sampled(spark, d):
    images, poses = _posed(spark, d)
    rows = sensors.sample_footprints(images, poses)
    size = lambda c: F.when(F.col("status") == "ok", F.size(c))
    return rows.select("model_id", "status", size("boundary").alias("boundary_points"), size("interior").alias("interior_points"), *(_r(F.col(c), n).alias(c) for c, n in (("longitude_anchor_deg", 6), ("lat_low", 7), ("lat_high", 7), ("lon_low", 6), ("lon_high", 6))), "is_polar")


@query(f"""WITH {_M}, z AS ({_PIXELS}), q AS (SELECT pixel_id, model_id, line, sample, 'c' AS k FROM z UNION ALL SELECT pixel_id, model_id, line + 2, sample, 'l' FROM z UNION ALL SELECT pixel_id, model_id, line, sample + 2, 's' FROM z), {_ground_sql('q')},
    w AS (SELECT c.*, l.lat AS llat, l.lon AS llon, s.lat AS slat, s.lon AS slon FROM g c JOIN g l ON l.pixel_id = c.pixel_id AND c.k = 'c' AND l.k = 'l' JOIN g s ON s.pixel_id = c.pixel_id AND s.k = 's'),
    h AS (SELECT *, 1737400.0e0 * asin(sqrt(sin(radians(llat - lat) / 2) ** 2 + cos(radians(lat)) * cos(radians(llat)) * sin(radians(llon - lon) / 2) ** 2)) AS gl, 1737400.0e0 * asin(sqrt(sin(radians(slat - lat) / 2) ** 2 + cos(radians(lat)) * cos(radians(slat)) * sin(radians(slon - lon) / 2) ** 2)) AS gs,
        cos(radians(lat)) * cos(radians(lon)) AS ux, cos(radians(lat)) * sin(radians(lon)) AS uy, sin(radians(lat)) AS uz FROM w),
    v AS (SELECT *, px - 1737400.0e0 * ux AS vx, py - 1737400.0e0 * uy AS vy, pz - 1737400.0e0 * uz AS vz, gl + gs IS NOT NULL AS ok FROM h), y AS (SELECT *, sqrt(vx * vx + vy * vy + vz * vz) AS far FROM v)
    SELECT pixel_id, CASE WHEN ok THEN 'ok' ELSE 'ground_unavailable' END AS status, CASE WHEN ok THEN round(gl, 3) END AS gsd_line_m, CASE WHEN ok THEN round(gs, 3) END AS gsd_sample_m, CASE WHEN ok THEN round(greatest(gl, gs) / 2, 3) END AS gsd_uncertainty_m,
    CASE WHEN ok AND covariance_m2 IS NOT NULL THEN round(degrees(acos(greatest(-1, least(1, (ux * vx + uy * vy + uz * vz) / far)))), 3) END AS view_zenith_deg, CASE WHEN ok AND covariance_m2 IS NOT NULL THEN round(degrees(atan2(5, far)), 7) END AS geometry_uncertainty_deg FROM y""")
def local_geometry_sampled(spark, d):
    _, poses = _posed(spark, d)
    rows = sensors.sample_local_geometry(_pixels(spark, d), poses, 2.0)
    digits = {"gsd_line_m": 3, "gsd_sample_m": 3, "gsd_uncertainty_m": 3, "view_zenith_deg": 3, "geometry_uncertainty_deg": 7}
    return rows.select("pixel_id", "status", *(_r(F.col(c), n).alias(c) for c, n in digits.items()))


@query(f"""WITH {_M} SELECT model_id, (n_rows * 3)::BIGINT AS attempted_samples, 183::BIGINT AS pose_samples, 183::BIGINT AS ground_samples, CASE WHEN model_id % 13 = 0 OR n_rows = 80 THEN 'unavailable' ELSE 'self_consistent' END AS validation,
    CASE WHEN model_id % 13 = 0 THEN 'kernels missing' WHEN n_rows = 80 THEN 'provider did not supply pose and ground intersections for all samples' ELSE 'furnished' END AS message FROM m""")
def provider_geometry_sampled(spark, d):
    images, poses = _posed(spark, d)
    off = F.col("model_id") % 13 == 0
    images = images.withColumns({"availability": F.when(off, "unavailable").otherwise("available"), "validation": F.lit("self_consistent"), "message": F.when(off, "kernels missing").otherwise("furnished")})
    return sensors.sample_provider_geometry(images, poses)
