"""Scalar geometry as column expressions: pixels, longitudes, distances, covariance and Jacobian algebra, windows, map projection."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: radius of the sphere in metres.
RADIUS_M = 1_737_400.0
#: Coordinate of the first pixel's centre by convention.
FIRST_PIXEL = {"zero_centre": 0.0, "gdal_centre": 0.5, "one_centre": 1.0}


def convert_pixel(value: Column, source: str, target: str) -> Column:
    return value - FIRST_PIXEL[source] + FIRST_PIXEL[target]


def normalize_longitude(deg: Column) -> Column:
    """Into [-180, 180)."""
    return F.pmod(deg + 180.0, F.lit(360.0)) - 180.0


def ground_distance(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Haversine distance in metres; null if a coordinate is."""
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), 2)
    return 2 * RADIUS_M * F.asin(F.sqrt(F.when(a > 1, 1.0).otherwise(a)))  # least would skip a null


def eigenvalues(xx: Column, xy: Column, yy: Column) -> tuple[Column, Column]:
    """Greatest and least eigenvalue of a symmetric 2 x 2 matrix."""
    mid, half = (xx + yy) / 2, F.hypot((xx - yy) / 2, xy)
    return mid + half, mid - half


def anisotropy(xx: Column, xy: Column, yy: Column) -> Column:
    big, small = eigenvalues(xx, xy, yy)
    return F.when(small > 0, F.sqrt(big / small))


def orientation_deg(xx: Column, xy: Column, yy: Column) -> Column:
    return F.degrees(F.atan2(2 * xy, xx - yy) / 2)


def transformed(j: tuple[Column, Column, Column, Column], xx: Column, xy: Column, yy: Column) -> tuple[Column, Column, Column]:
    """J C J' for J = [[a, b], [c, d]]."""
    a, b, c, d = j
    return a * a * xx + 2 * a * b * xy + b * b * yy, a * c * xx + (a * d + b * c) * xy + b * d * yy, c * c * xx + 2 * c * d * xy + d * d * yy


def jacobian_inverse(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Struct of the inverse's entries; null if singular (|det| < 1e-12)."""
    det = a * d - b * c
    ok = F.abs(det) >= 1e-12
    return F.when(ok, F.struct((d / det).alias("a"), (-b / det).alias("b"), (-c / det).alias("c"), (a / det).alias("d")))


def window_intersection(lo1: Column, hi1: Column, lo2: Column, hi2: Column) -> Column:
    """Length of the intersection of half-open ranges; 0 if they are disjoint."""
    return F.greatest(F.least(hi1, hi2) - F.greatest(lo1, lo2), F.lit(0))


def equirectangular(lat: Column, lon: Column, lon0: float = 0.0) -> tuple[Column, Column]:
    return F.radians(normalize_longitude(lon - lon0)) * RADIUS_M, F.radians(lat) * RADIUS_M


def polar_stereographic(lat: Column, lon: Column, north: bool = True, lon0: float = 0.0) -> tuple[Column, Column]:
    s = 1.0 if north else -1.0
    r = 2 * RADIUS_M * F.tan(F.lit(math.pi / 4) - F.radians(lat * s) / 2)
    turn = F.radians(lon - lon0)
    return r * F.sin(turn), r * F.cos(turn) * -s


def from_equirectangular(x: Column, y: Column, lon0: float = 0.0) -> tuple[Column, Column]:
    """Latitude and longitude of map coordinates."""
    return F.degrees(y / RADIUS_M), normalize_longitude(F.degrees(x / RADIUS_M) + lon0)


def from_polar_stereographic(x: Column, y: Column, north: bool = True, lon0: float = 0.0) -> tuple[Column, Column]:
    s = 1.0 if north else -1.0
    lat = s * (90.0 - 2 * F.degrees(F.atan2(F.hypot(x, y), F.lit(2 * RADIUS_M))))
    return lat, normalize_longitude(F.degrees(F.atan2(x, y * -s)) + lon0)


#: Fixed value: latitude from which a route takes a polar projection.
POLAR_DEG = 75.0


def select_crs(low: Column, high: Column) -> Column:
    """Struct of projection and error for a latitude range: polar as soon as the range reaches POLAR_DEG; ranges that no projection serves have an error instead."""
    error = (
        F.when(~F.coalesce((low >= -90) & (low <= high) & (high <= 90), F.lit(False)), "bounds_not_ordered")
        .when((high >= POLAR_DEG) & (low <= -POLAR_DEG), "spans_both_caps")
        .when((high >= POLAR_DEG) & (low < 0), "north_crosses_equator")
        .when((low <= -POLAR_DEG) & (high > 0), "south_crosses_equator")
    )
    name = F.when(high >= POLAR_DEG, "north_polar_stereographic").when(low <= -POLAR_DEG, "south_polar_stereographic").otherwise("equirectangular")
    return F.struct(F.when(error.isNull(), name).alias("projection"), error.alias("error"))


def east_positive(deg: Column) -> Column:
    """Into [0, 360)."""
    return F.pmod(deg, F.lit(360.0))


def unwrap_longitudes(degs: Column, anchor: Column | None = None) -> Column:
    """Array of longitudes made continuous around the anchor (else their circular mean, else the first)."""
    total = lambda f: F.aggregate(degs, F.lit(0.0), lambda a, x: a + f(F.radians(x)))
    s, c = total(F.sin), total(F.cos)
    mean = F.when((s != 0) | (c != 0), F.degrees(F.atan2(s, c))).otherwise(F.get(degs, 0))
    at = mean if anchor is None else F.coalesce(anchor, mean)
    return F.transform(degs, lambda x: at + F.pmod(normalize_longitude(x) - at + 180.0, F.lit(360.0)) - 180.0)


def ground_sampling(line_y: Column, line_x: Column, sample_y: Column, sample_x: Column) -> Column:
    """Struct of ground sampling distances along lines and samples from the steps to the neighbours in metres, and half the greater as uncertainty."""
    a, b = F.hypot(line_y, line_x), F.hypot(sample_y, sample_x)
    return F.struct(a.alias("gsd_line_m"), b.alias("gsd_sample_m"), (F.greatest(a, b) * 0.5).alias("uncertainty_m"))


def view_angle(lat: Column, lon: Column, height: Column, x: Column, y: Column, z: Column) -> Column:
    """Angle in degrees between the surface normal at a ground point and the direction to a position (metres); null where they coincide."""
    lat, lon = F.radians(lat), F.radians(lon)
    normal = (F.cos(lat) * F.cos(lon), F.cos(lat) * F.sin(lon), F.sin(lat))
    view = [p - (height + RADIUS_M) * n for p, n in zip((x, y, z), normal, strict=True)]
    length = F.sqrt(sum((v * v for v in view[1:]), view[0] * view[0]))
    cosine = sum((n * v for n, v in zip(normal[1:], view[1:], strict=True)), normal[0] * view[0])
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(cosine, length)))))


def jacobian_apply(j: tuple[Column, Column, Column, Column], line: Column, sample: Column) -> tuple[Column, Column]:
    a, b, c, d = j
    return a * line + b * sample, c * line + d * sample


def prior_displacement(j: tuple[Column, Column, Column, Column], shift: tuple[Column, Column], line: Column, sample: Column, anchor: tuple[Column, Column]) -> tuple[Column, Column]:
    """Displacement that a prior predicts at a pixel: its shift, and what the warp adds away from the anchor."""
    dl, ds = line - anchor[0], sample - anchor[1]
    ml, ms = jacobian_apply(j, dl, ds)
    return shift[0] + ml - dl, shift[1] + ms - ds


def window_contains(lo: Column, hi: Column, inner_lo: Column, inner_hi: Column) -> Column:
    return (lo <= inner_lo) & (inner_hi <= hi)


def halo_overhead(lines: Column, samples: Column, halo: Column) -> Column:
    """Area read with its halo over the core's area."""
    return (lines + 2 * halo) * (samples + 2 * halo) / (lines * samples)


def confidence_of(log_variance: Column, offset: float, scale: float) -> Column:
    """Falling logistic of a log variance; exponentials of positive numbers are never taken."""
    e = (log_variance - offset) / scale
    small = F.exp(-F.abs(e))
    return F.when(e >= 0, small / (1 + small)).otherwise(1 / (1 + small))


def isotropic_variance(log_variance: Column) -> Column:
    """exp where that is a normal positive number, else null."""
    return F.when((log_variance > math.log(2.2250738585072014e-308)) & (log_variance < math.log(1.7976931348623157e308)), F.exp(log_variance))


def affine_residual(j: tuple[Column, Column, Column, Column], shift: tuple[Column, Column], line: Column, sample: Column, ref_line: Column, ref_sample: Column) -> Column:
    u, v = jacobian_apply(j, line, sample)
    return F.hypot(u + shift[0] - ref_line, v + shift[1] - ref_sample)


#: How far the off-diagonal entries of a normal matrix may differ, absolutely and by size.
SYMMETRY_ATOL, SYMMETRY_RTOL = 1e-8, 1e-5


def hessian_covariance(a: Column, b: Column, c: Column, d: Column, variance: Column, limit: float, scale: Column | None = None) -> Column:
    """Covariance struct<xx,xy,yy,calibrated> of the normal matrix [[a, b], [c, d]]: variance times its inverse, times the calibrated
    scale if one is given. Null where the matrix isn't symmetric, its condition exceeds limit, or the result isn't positive definite."""
    symmetric = F.greatest(F.abs(b - c) - SYMMETRY_RTOL * F.abs(c), F.abs(b - c) - SYMMETRY_RTOL * F.abs(b)) <= SYMMETRY_ATOL
    big, small = eigenvalues(a, (b + c) / 2, d)
    sound = F.greatest(F.abs(big), F.abs(small)) <= limit * F.least(F.abs(big), F.abs(small))
    det = a * d - b * c
    xx, xy, yy = (F.try_divide(variance * v, det) for v in (d, -(b + c) / 2, a))
    definite = (xx > 0) & (yy > 0) & (xx * yy - xy * xy > 0)
    factor = F.lit(1.0) if scale is None else F.coalesce(scale, F.lit(1.0))
    calibrated = F.lit(False) if scale is None else scale.isNotNull()
    scaled = [F.try_divide(factor * variance * v, det).alias(n) for n, v in (("xx", d), ("xy", -(b + c) / 2), ("yy", a))]
    value = F.struct(*scaled, calibrated.alias("calibrated"))
    return F.when(symmetric & sound & definite & (det != 0), value)
