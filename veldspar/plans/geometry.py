"""Queries of scalar geometry over the test tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from veldspar.functions import geometry as geo
from veldspar.plans.registry import _r, _t, query

_BOUNDS = "o_orderkey AS id, (o_orderkey * 7 % 190) - 95.0e0 AS low, (o_orderkey * 7 % 190) - 95.0e0 + (o_custkey % 120) AS high"


@query(f"""WITH b AS (SELECT {_BOUNDS} FROM orders), e AS (SELECT *, CASE WHEN NOT (low >= -90 AND high <= 90) THEN 'bounds_not_ordered' WHEN high >= 75 AND low <= -75 THEN 'spans_both_caps'
    WHEN high >= 75 AND low < 0 THEN 'north_crosses_equator' WHEN low <= -75 AND high > 0 THEN 'south_crosses_equator' END AS error FROM b)
    SELECT id, error, CASE WHEN error IS NOT NULL THEN NULL WHEN high >= 75 THEN 'north_polar_stereographic' WHEN low <= -75 THEN 'south_polar_stereographic' ELSE 'equirectangular' END AS projection FROM e""")
def crs_selection(spark, d):
    rows = _t(spark, d, "orders").selectExpr(*_BOUNDS.replace("e0", "D").split(", "))
    return rows.withColumn("crs", geo.select_crs(F.col("low"), F.col("high"))).select("id", "crs.error", "crs.projection")


_PLACE = "o_orderkey AS id, (o_orderkey * 7 % 700) / 10.0e0 + 15 AS lat, (o_custkey * 31 % 3600) / 10.0e0 - 180 AS lon"


@query(f"""WITH p AS (SELECT {_PLACE} FROM orders), m AS (SELECT *, radians(CASE WHEN lon - 20 < -180 THEN lon + 340 ELSE lon - 20 END) * 1737400 AS x, radians(lat) * 1737400 AS y,
    2 * 1737400 * tan(pi() / 4 - radians(lat) / 2) AS r FROM p) SELECT id, round(x, 3) AS x, round(y, 3) AS y, round(r * sin(radians(lon - 20)), 3) AS px, round(-r * cos(radians(lon - 20)), 3) AS py,
    round(lat, 6) AS lat, round(lon, 6) AS lon, round(lat, 6) AS polar_lat, round(lon, 6) AS polar_lon FROM m""")
def map_projections(spark, d):
    p = _t(spark, d, "orders").selectExpr(*_PLACE.replace("e0", "D").split(", "))
    lat, lon = F.col("lat"), F.col("lon")
    (x, y), (px, py) = geo.equirectangular(lat, lon, 20.0), geo.polar_stereographic(lat, lon, True, 20.0)
    p = p.select("id", x.alias("x"), y.alias("y"), px.alias("px"), py.alias("py"))
    back, polar = geo.from_equirectangular(F.col("x"), F.col("y"), 20.0), geo.from_polar_stereographic(F.col("px"), F.col("py"), True, 20.0)
    whole = lambda c: F.when(F.abs(c - 180.0) < 1e-7, c - 360.0).otherwise(c)  # noqa: E731  the seam may come back on its other side
    return p.select("id", *[_r(F.col(c), 3).alias(c) for c in ("x", "y", "px", "py")], _r(back[0]).alias("lat"), _r(whole(back[1])).alias("lon"), _r(polar[0]).alias("polar_lat"), _r(whole(polar[1])).alias("polar_lon"))


@query("""WITH l AS (SELECT l_orderkey AS id, ((l_partkey * 13 % 40) + 165.5e0) AS lon, l_linenumber, l_suppkey FROM lineitem), a AS (SELECT id, degrees(atan2(sum(sin(radians(lon))), sum(cos(radians(lon))))) AS anchor FROM l GROUP BY id),
    u AS (SELECT id, anchor, anchor + (w - anchor + 180 - 360 * floor((w - anchor + 180) / 360)) - 180 AS v, lon FROM (SELECT l.id, anchor, lon, lon - 360 * floor((lon + 180) / 360) AS w FROM l JOIN a ON a.id = l.id))
    SELECT id, round(min(v), 5) AS west, round(max(v), 5) AS east, round(max(CASE WHEN lon >= 360 THEN lon - 360 ELSE lon END), 5) AS greatest_east_positive FROM u GROUP BY id""")
def unwrapped_longitudes(spark, d):
    rows = _t(spark, d, "lineitem").selectExpr("l_orderkey AS id", "(l_partkey * 13 % 40) + 165.5D AS lon").groupBy("id").agg(F.sort_array(F.collect_list("lon")).alias("lons"))
    v = geo.unwrap_longitudes(F.col("lons"))
    return rows.select("id", _r(F.array_min(v), 5).alias("west"), _r(F.array_max(v), 5).alias("east"), _r(F.array_max(F.transform("lons", geo.east_positive)), 5).alias("greatest_east_positive"))


_STEPS = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity AS a, l_tax * 10 AS b, l_discount * 30 AS c, l_quantity / 2 + 1 AS e"


@query(f"""WITH s AS (SELECT {_STEPS} FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(sqrt(a * a + b * b), 6) AS gsd_line_m, round(sqrt(c * c + e * e), 6) AS gsd_sample_m,
    round(0.5 * greatest(sqrt(a * a + b * b), sqrt(c * c + e * e)), 6) AS uncertainty_m, round((100 + 2 * (l_linenumber % 5)) * (80 + 2 * (l_linenumber % 5)) / (100 * 80.0e0), 6) AS halo_overhead,
    l_suppkey % 50 <= l_partkey % 60 AND l_partkey % 60 + 4 <= l_suppkey % 50 + 30 AS contains, greatest(least(l_suppkey % 50 + 30, l_partkey % 60 + 4) - greatest(l_suppkey % 50, l_partkey % 60), 0) AS overlap,
    round(CASE WHEN a - 20 >= 0 THEN exp(-(a - 20) / 7) / (1 + exp(-(a - 20) / 7)) ELSE 1 / (1 + exp((a - 20) / 7)) END, 9) AS confidence, round(CASE WHEN a > 3 THEN exp(-a / 10) END, 9) AS variance FROM s""")
def sampling_and_windows(spark, d):
    s = _t(spark, d, "lineitem").selectExpr(*_STEPS.split(", "))
    g, halo, lo, inner = geo.ground_sampling(*map(F.col, "abce")), F.col("l_linenumber") % 5, F.col("l_suppkey") % 50, F.col("l_partkey") % 60
    return s.withColumn("g", g).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *[_r(F.col(f"g.{c}")).alias(c) for c in ("gsd_line_m", "gsd_sample_m", "uncertainty_m")],
        _r(geo.halo_overhead(F.lit(100.0), F.lit(80.0), halo)).alias("halo_overhead"), geo.window_contains(lo, lo + 30, inner, inner + 4).alias("contains"),
        geo.window_intersection(lo, lo + 30, inner, inner + 4).alias("overlap"), _r(geo.confidence_of(F.col("a"), 20.0, 7.0), 9).alias("confidence"),
        _r(geo.isotropic_variance(F.when(F.col("a") > 3, -F.col("a") / 10).otherwise(-1000.0)), 9).alias("variance"),
    )


_WARP = "l_orderkey, l_linenumber, l_partkey, l_suppkey, 1 + l_tax AS a, l_discount AS b, -l_discount AS c, 1 - l_tax / 2 AS e, l_quantity AS line, l_suppkey % 97 AS sample"


@query(f"""WITH w AS (SELECT {_WARP} FROM lineitem), i AS (SELECT *, a * e - b * c AS det, line - 10 AS dl, sample - 20 AS ds FROM w)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(e / det, 9) AS ia, round(-b / det, 9) AS ib, round(-c / det, 9) AS ic, round(a / det, 9) AS ie, round(3 + a * dl + b * ds - dl, 6) AS dy, round(-2 + c * dl + e * ds - ds, 6) AS dx,
    round(sqrt((a * line + b * sample + 3 - line) ** 2 + (c * line + e * sample - 2 - sample) ** 2), 6) AS residual_px, round(a * a * 2 + 2 * a * b * 0.5 + b * b, 6) AS xx,
    round(a * c * 2 + (a * e + b * c) * 0.5 + b * e, 6) AS xy, round(c * c * 2 + 2 * c * e * 0.5 + e * e, 6) AS yy, round(line - 1 + 0.5, 6) AS pixel FROM i""")
def warps_and_priors(spark, d):
    w = _t(spark, d, "lineitem").selectExpr(*_WARP.split(", "))
    j, line, sample = tuple(map(F.col, "abce")), F.col("line"), F.col("sample").cast("double")
    dy, dx = geo.prior_displacement(j, (F.lit(3.0), F.lit(-2.0)), line, sample, (F.lit(10.0), F.lit(20.0)))
    moved = geo.transformed(j, F.lit(2.0), F.lit(0.5), F.lit(1.0))
    rows = w.withColumn("inv", geo.jacobian_inverse(*j))
    return rows.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *[_r(F.col(f"inv.{k}"), 9).alias(n) for k, n in zip("abcd", ("ia", "ib", "ic", "ie"), strict=True)], _r(dy).alias("dy"), _r(dx).alias("dx"),
        _r(geo.affine_residual(j, (F.lit(3.0), F.lit(-2.0)), line, sample, line, sample)).alias("residual_px"), *[_r(c).alias(n) for c, n in zip(moved, ("xx", "xy", "yy"), strict=True)],
        _r(geo.convert_pixel(line, "one_centre", "gdal_centre")).alias("pixel"),
    )
