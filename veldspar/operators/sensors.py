"""Sampling of sensor models that are tables: poses by line, interpolated between their neighbours, and rays met with the sphere.

poses: model_id, line, x, y, z (body-fixed metres), the viewing direction at the middle sample (bx, by, bz) and its change a sample (ax, ay, az), middle (that sample), attitude_source,
covariance_m2 (or null). A pixel between two poses of a model gets their linear mean; before the first or after the last pose, or where a gap is wider than the most lines
allowed, there is none, and nothing is made up. Pixels and pose segments meet by blocks of lines (an equi-join): a model may have any number of poses and pixels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veldspar.functions.geometry import RADIUS_M, ground_distance, unwrap_longitudes, view_angle
from veldspar.tables import sized

#: Lines of a block by which pixels and pose segments meet.
BLOCK = 256
#: Fixed value: latitude (degrees, either sign) from which a footprint is polar.
POLAR = 85.0
_POSE = ("x", "y", "z", "bx", "by", "bz", "ax", "ay", "az", "middle")


def segments(poses: DataFrame, most_lines: float) -> DataFrame:
    """Neighbouring poses of a model, with the blocks that they cover: line, to_line, and both poses; a last pose is a segment of its own."""
    w = Window.partitionBy("model_id").orderBy("line")
    after = {f"n_{c}": F.lead(c).over(w) for c in ("line", *_POSE)}
    rows = poses.withColumns(after).withColumn("to_line", F.when(F.col("n_line") - F.col("line") <= most_lines, F.col("n_line")).otherwise(F.col("line")))
    return rows.withColumn("_block", F.explode(F.sequence(F.floor(F.col("line") / BLOCK), F.floor(F.col("to_line") / BLOCK))))


def poses_at(pixels: DataFrame, poses: DataFrame, most_lines: float = 1e6) -> DataFrame:
    """pixels (model_id, line, sample among others) with the pose at their line, null columns where there is none. One join: a pixel meets one segment of its model at most."""
    rows = pixels.withColumn("_block", F.floor(F.col("line") / BLOCK))
    seg = segments(poses, most_lines).select(F.col("model_id").alias("_model"), F.col("_block").alias("_of"), F.col("line").alias("_from"), F.col("to_line").alias("_to"), *(F.col(c).alias(f"_a_{c}") for c in _POSE), *(F.col(f"n_{c}").alias(f"_b_{c}") for c in _POSE), "attitude_source", "covariance_m2")
    inside = (F.col("line") == F.col("_from")) | ((F.col("line") > F.col("_from")) & (F.col("line") < F.col("_to")))
    met = rows.join(sized(seg), (F.col("model_id") == F.col("_model")) & (F.col("_block") == F.col("_of")) & inside, "left")
    share = F.when(F.col("_to") > F.col("_from"), (F.col("line") - F.col("_from")) / (F.col("_to") - F.col("_from"))).otherwise(0.0)
    mean = {c: F.when(share == 0, F.col(f"_a_{c}")).otherwise(F.col(f"_a_{c}") * (1 - share) + F.col(f"_b_{c}") * share) for c in _POSE}
    return met.select(*(F.col(c) for c in pixels.columns), *(v.alias(k) for k, v in mean.items()), "attitude_source", "covariance_m2")


def ground_at(pixels: DataFrame, poses: DataFrame, most_lines: float = 1e6, radius: float = RADIUS_M) -> DataFrame:
    """pixels with their pose and latitude_deg, longitude_deg (in [-180, 180)) of the first point of the sphere on their ray; null without a pose or where the ray misses."""
    rows = poses_at(pixels, poses, most_lines)
    off = F.col("sample") - F.col("middle")
    d = [F.col(f"b{c}") + off * F.col(f"a{c}") for c in "xyz"]
    p = [F.col(c) for c in "xyz"]
    dot = lambda a, b: a[0] * b[0] + a[1] * b[1] + a[2] * b[2]
    rows = rows.withColumns({"_dd": dot(d, d), "_pd": dot(p, d), "_pp": dot(p, p)})
    under = F.col("_pd") * F.col("_pd") - F.col("_dd") * (F.col("_pp") - radius * radius)
    t = F.when((under >= 0) & (F.col("_pd") < 0), (-F.col("_pd") - F.sqrt(under)) / F.col("_dd"))
    rows = rows.withColumn("_t", F.when(t >= 0, t))
    g = [a + F.col("_t") * b for a, b in zip(p, d, strict=True)]
    lat = F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), g[2] / radius))))
    lon = F.degrees(F.atan2(g[1], g[0]))
    lat = F.when(F.col("_t").isNotNull(), lat)  # greatest and least skip nulls
    return rows.withColumns({"latitude_deg": lat, "longitude_deg": F.when(lon >= 180, lon - 360).otherwise(lon)}).drop("_dd", "_pd", "_pp", "_t")


def _span(n: Column, count: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: i * (n - 1) / (count - 1))


def boundary_pixels(rows: Column, columns: Column, per_edge: int) -> Column:
    """The boundary's pixels in order: along the first line, down the last sample, back along the last line, up the first sample; corners once."""
    if per_edge < 2:
        raise ValueError("an edge has two samples at least")
    at = lambda line, sample: F.struct(line.cast("double").alias("line"), sample.cast("double").alias("sample"))
    xs, ys, zero = _span(columns, per_edge), _span(rows, per_edge), F.lit(0.0)
    right, bottom, left = F.slice(ys, 2, per_edge - 1), F.reverse(F.slice(xs, 1, per_edge - 1)), F.reverse(F.slice(ys, 2, max(per_edge - 2, 0)))
    return F.concat(F.transform(xs, lambda x: at(zero, x)), F.transform(right, lambda y: at(y, columns - 1)), F.transform(bottom, lambda x: at(rows - 1, x)), F.transform(left, lambda y: at(y, zero)))


def sample_footprints(images: DataFrame, poses: DataFrame, per_edge: int = 9, interior: tuple[int, int] = (3, 3), most_lines: float = 1e6) -> DataFrame:
    """images: model_id, rows, columns (2 at least). Per image: status (ok, boundary_unavailable or interior_unavailable), boundary and interior (arrays of latitude_deg, longitude_deg, in order), the longitude
    anchor (mean of all longitudes unwrapped around their circular mean), latitude and unwrapped longitude bounds, is_polar. A missing intersection leaves all but the status null; validation is always synthetic."""
    if min(interior) < 1:
        raise ValueError("an interior of one point at least")
    inner = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(interior[0])), lambda r: F.transform(F.sequence(F.lit(1), F.lit(interior[1])), lambda c: F.struct((r * (F.col("rows") - 1) / (interior[0] + 1)).alias("line"), (c * (F.col("columns") - 1) / (interior[1] + 1)).alias("sample")))))
    edge = boundary_pixels(F.col("rows"), F.col("columns"), per_edge)
    sides = F.array(F.struct(F.lit("boundary").alias("side"), edge.alias("pixels")), F.struct(F.lit("interior").alias("side"), inner.alias("pixels")))
    pixels = images.where("rows >= 2 and columns >= 2").select("model_id", F.explode(sides).alias("s")).select("model_id", "s.side", F.posexplode("s.pixels").alias("at", "p")).select("model_id", "side", "at", "p.line", "p.sample")
    seen = ground_at(pixels, poses, most_lines)
    point = F.when(F.col("latitude_deg").isNotNull(), F.struct("at", "latitude_deg", "longitude_deg"))
    of = lambda side: F.sort_array(F.collect_list(F.when(F.col("side") == side, point)))  # noqa: E731  a few dozen points an image
    lost = lambda side: F.coalesce(F.bool_or((F.col("side") == side) & F.col("latitude_deg").isNull()), F.lit(False))
    rows = seen.groupBy("model_id").agg(of("boundary").alias("b"), of("interior").alias("i"), lost("boundary").alias("lost_b"), lost("interior").alias("lost_i"))
    rows = rows.withColumn("status", F.when(F.col("lost_b"), "boundary_unavailable").when(F.col("lost_i"), "interior_unavailable").otherwise("ok"))
    ok = F.col("status") == "ok"
    lons = unwrap_longitudes(F.transform(F.concat("b", "i"), lambda p: p["longitude_deg"]))
    rows = rows.withColumn("_lons", F.when(ok, lons))
    rows = rows.withColumn("longitude_anchor_deg", F.aggregate("_lons", F.lit(0.0), lambda a, x: a + x) / F.size("_lons"))
    edge_lons = unwrap_longitudes(F.transform("b", lambda p: p["longitude_deg"]), F.col("longitude_anchor_deg"))
    lats = F.transform(F.concat("b", "i"), lambda p: p["latitude_deg"])
    bare = lambda c: F.when(ok, F.transform(c, lambda p: F.struct(p["latitude_deg"].alias("latitude_deg"), p["longitude_deg"].alias("longitude_deg"))))
    return rows.select(
        "model_id", "status", bare("b").alias("boundary"), bare("i").alias("interior"), "longitude_anchor_deg", F.when(ok, F.array_min(lats)).alias("lat_low"), F.when(ok, F.array_max(lats)).alias("lat_high"),
        F.when(ok, F.array_min(edge_lons)).alias("lon_low"), F.when(ok, F.array_max(edge_lons)).alias("lon_high"), F.when(ok, F.exists(lats, lambda x: F.abs(x) >= POLAR)).alias("is_polar"), F.lit("synthetic").alias("validation"),
    )


def sample_local_geometry(pixels: DataFrame, poses: DataFrame, step: float = 1.0, most_lines: float = 1e6) -> DataFrame:
    """pixels: pixel_id, model_id, line, sample, and covariance_m2 of the pose by the poses. Ground sampling distances to the neighbours a step on, their uncertainty, the view angle from the pose and its uncertainty (null without a
    covariance). status: ok, or ground_unavailable where one of the three intersections is missing."""
    if not step > 0:
        raise ValueError("a positive step")
    around = F.array(*(F.struct(F.lit(k).alias("k"), (F.col("line") + i * step).alias("line"), (F.col("sample") + j * step).alias("sample")) for k, i, j in (("centre", 0, 0), ("line", 1, 0), ("sample", 0, 1))))
    three = pixels.select("pixel_id", "model_id", F.explode(around).alias("p")).select("pixel_id", "model_id", "p.k", "p.line", "p.sample")
    seen = ground_at(three, poses, most_lines)
    of = lambda k, *cs: F.max(F.when(F.col("k") == k, F.struct(*cs)))
    rows = seen.groupBy("pixel_id").agg(of("centre", "latitude_deg", "longitude_deg", "x", "y", "z", "covariance_m2").alias("c"), of("line", "latitude_deg", "longitude_deg").alias("l"), of("sample", "latitude_deg", "longitude_deg").alias("s"))
    gsd = {k: ground_distance(F.col("c.latitude_deg"), F.col("c.longitude_deg"), F.col(f"{p}.latitude_deg"), F.col(f"{p}.longitude_deg")) / step for k, p in (("gsd_line_m", "l"), ("gsd_sample_m", "s"))}
    rows = rows.withColumns(gsd)
    ok = F.col("gsd_line_m").isNotNull() & F.col("gsd_sample_m").isNotNull()
    lat, lon = F.radians("c.latitude_deg"), F.radians("c.longitude_deg")
    ground = (RADIUS_M * F.cos(lat) * F.cos(lon), RADIUS_M * F.cos(lat) * F.sin(lon), RADIUS_M * F.sin(lat))
    view = [F.col(f"c.{k}") - v for k, v in zip("xyz", ground, strict=True)]
    length = F.sqrt(view[0] * view[0] + view[1] * view[1] + view[2] * view[2])
    sure = ok & F.coalesce(F.col("c.covariance_m2") >= 0, F.lit(False))
    zenith = view_angle(F.col("c.latitude_deg"), F.col("c.longitude_deg"), F.lit(0.0), F.col("c.x"), F.col("c.y"), F.col("c.z"))
    return rows.select(
        "pixel_id", F.when(ok, "ok").otherwise("ground_unavailable").alias("status"), *(F.when(ok, F.col(k)).alias(k) for k in gsd), F.when(ok, 0.5 * F.greatest(*gsd)).alias("gsd_uncertainty_m"),
        F.when(sure, zenith).alias("view_zenith_deg"), F.when(sure, F.degrees(F.atan2(F.sqrt("c.covariance_m2"), length))).alias("geometry_uncertainty_deg"),
    )


def sample_provider_geometry(images: DataFrame, poses: DataFrame, samples_per_line: int = 3, most_lines: float = 1e6) -> DataFrame:
    """images: model_id, rows, columns, availability (available, unavailable, not_validated), validation and message of the provider's kernels. Every line is sampled: attempted_samples, pose_samples, ground_samples,
    validation (unavailable where the provider is, or where a sample is missing, else the kernels' own) and why."""
    if samples_per_line < 1:
        raise ValueError("one sample a line at least")
    across = F.array(F.lit(0.0)) if samples_per_line == 1 else _span(F.col("columns"), samples_per_line)
    pixels = images.select("model_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows").cast("long") - 1)).alias("line"), across.alias("a")).select("model_id", "line", F.explode("a").alias("sample"))
    seen = ground_at(pixels, poses, most_lines).groupBy("model_id").agg(F.count(F.lit(1)).alias("attempted_samples"), F.count("x").alias("pose_samples"), F.count("latitude_deg").alias("ground_samples"))
    rows = images.join(seen, "model_id")
    short = (F.col("pose_samples") < F.col("attempted_samples")) | (F.col("ground_samples") < F.col("attempted_samples"))
    state = F.when((F.col("availability") == "unavailable") | short, "unavailable").otherwise(F.col("validation"))
    why = F.when(F.col("availability") == "unavailable", F.col("message")).when(short, "provider did not supply pose and ground intersections for all samples").otherwise(F.col("message"))
    return rows.select("model_id", "attempted_samples", "pose_samples", "ground_samples", state.alias("validation"), why.alias("message"))
