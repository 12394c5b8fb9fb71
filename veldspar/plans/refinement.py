"""Queries of patches and spectral bands over the test tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from veldspar.operators import matching, pyramid, refine, subpixel, tiling
from veldspar.plans.registry import _DENSE, _blur_sql, _r, _t, dense_pixels, query

_POINT = "l_orderkey * 10000 + l_linenumber * 1000 + l_suppkey % 1000 AS point_id, cast(l_suppkey % 10 AS bigint) AS image_id, (l_partkey % 90) / 2.0e0 AS line, (l_orderkey % 130) / 2.0e0 AS sample"
_POINTS_SQL = f"pt AS (SELECT point_id, min(image_id) AS image_id, min(line) AS line, min(sample) AS sample FROM (SELECT {_POINT} FROM lineitem) GROUP BY 1)"


def _points(spark, d):
    rows = _t(spark, d, "lineitem").selectExpr(*_POINT.replace("e0", "D").split(", "))
    return rows.groupBy("point_id").agg(*[F.min(c).alias(c) for c in ("image_id", "line", "sample")])


_PATCH = f"""WITH {_DENSE}, {_POINTS_SQL}, c AS (SELECT point_id, image_id, round_even(line, 0)::BIGINT AS l, round_even(sample, 0)::BIGINT AS s FROM pt), k AS (SELECT c.point_id, y AS dy, x AS dx, d.value, d.valid FROM c, range(-2, 3) a(y), range(-2, 3) b(x), d
    WHERE d.image_id = c.image_id AND d.line = c.l + y AND d.sample = c.s + x), n AS (SELECT point_id, count(*) AS n, count(*) FILTER (valid) AS v FROM k GROUP BY 1), j AS (SELECT pt.point_id, CASE WHEN coalesce(n, 0) < 25 THEN 'out_of_bounds' WHEN v / 25.0e0 < 0.7 THEN 'too_few_valid' ELSE 'ok' END AS status, CASE WHEN n = 25 THEN v / 25.0e0 END AS f FROM pt LEFT JOIN n ON n.point_id = pt.point_id)"""


@query(f"{_PATCH} SELECT point_id, status, round(f, 6) AS valid_fraction FROM j")
def patches_extracted(spark, d):
    rows = refine.patches(_points(spark, d), dense_pixels(spark, d), 2, 0.7, with_cells=False)
    return rows.select("point_id", "status", _r(F.col("valid_fraction")).alias("valid_fraction"))


@query(f"""{_PATCH}, q AS (SELECT k.* FROM k JOIN j ON j.point_id = k.point_id WHERE status = 'ok'), g AS (SELECT a.point_id, (lo_y.value - hi_y.value) / CASE WHEN abs(a.dy) = 2 THEN 1 ELSE 2 END AS gy, (lo_x.value - hi_x.value) / CASE WHEN abs(a.dx) = 2 THEN 1 ELSE 2 END AS gx FROM q a
        JOIN q lo_y ON lo_y.point_id = a.point_id AND lo_y.dx = a.dx AND lo_y.dy = greatest(a.dy - 1, -2) JOIN q hi_y ON hi_y.point_id = a.point_id AND hi_y.dx = a.dx AND hi_y.dy = least(a.dy + 1, 2)
        JOIN q lo_x ON lo_x.point_id = a.point_id AND lo_x.dy = a.dy AND lo_x.dx = greatest(a.dx - 1, -2) JOIN q hi_x ON hi_x.point_id = a.point_id AND hi_x.dy = a.dy AND hi_x.dx = least(a.dx + 1, 2))
    SELECT point_id, round(avg(gy * gy + gx * gx), 8) AS texture FROM g GROUP BY 1""")
def patch_texture(spark, d):
    return refine.textures(_points(spark, d), dense_pixels(spark, d), 2, 0.7).select("point_id", _r(F.col("texture"), 8).alias("texture"))


@query(f"""WITH {_DENSE}, {_POINTS_SQL}, c AS (SELECT point_id, pt.image_id, least(greatest(line - 0.25, 0), h - 1) AS y, least(greatest(sample - 0.6, 0), w - 1) AS x, h, w FROM pt JOIN h ON h.image_id = pt.image_id), f AS (SELECT *, floor(y)::BIGINT AS y0, floor(x)::BIGINT AS x0, y - floor(y) AS fy, x - floor(x) AS fx FROM c)
    SELECT point_id, round((1 - fy) * ((1 - fx) * a.value + fx * b.value) + fy * ((1 - fx) * p.value + fx * q.value), 6) AS value FROM f JOIN d a ON a.image_id = f.image_id AND a.line = y0 AND a.sample = x0 JOIN d b ON b.image_id = f.image_id AND b.line = y0 AND b.sample = least(x0 + 1, w - 1)
    JOIN d p ON p.image_id = f.image_id AND p.line = least(y0 + 1, h - 1) AND p.sample = x0 JOIN d q ON q.image_id = f.image_id AND q.line = least(y0 + 1, h - 1) AND q.sample = least(x0 + 1, w - 1)""")
def bilinear_samples(spark, d):
    points = _points(spark, d).withColumn("line", F.col("line") - 0.25).withColumn("sample", F.col("sample") - 0.6)
    return refine.bilinear_samples(points, dense_pixels(spark, d)).select("point_id", _r(F.col("value")).alias("value"))


@query("""WITH l AS (SELECT p_partkey AS id, CASE WHEN p_size % 3 > 0 THEN p_size % 6 END AS declared, p_size % 5 AS c, p_size % 4 AS w, CASE p_partkey % 4 WHEN 0 THEN 'NM ' WHEN 1 THEN 'um' WHEN 2 THEN 'furlong' END AS unit FROM part),
    b AS (SELECT id, unnest(range(coalesce(declared, greatest(c, w, 2)))) AS i, c, w, unit, declared FROM l) SELECT id AS label_id, i::INT + 1 AS band_number, CASE WHEN i < c THEN CASE trim(lower(unit)) WHEN 'nm' THEN 500.0 + i WHEN 'um' THEN (500.0 + i) * 1000 END END::DOUBLE AS center_wavelength_nm,
    CASE WHEN i < w THEN 10.0 END::DOUBLE AS fwhm_nm, CASE i WHEN 0 THEN true WHEN 1 THEN false END AS is_bad_band, concat_ws(',', CASE WHEN i < c AND unit IS NULL THEN 'center_without_unit' WHEN i < c AND unit = 'furlong' THEN 'center_unit_unknown' END, CASE WHEN declared IS NULL THEN 'count_inferred' END) AS warnings FROM b""")
def label_bands(spark, d):
    p = _t(spark, d, "part").selectExpr("p_partkey AS label_id", "CASE WHEN p_size % 3 > 0 THEN p_size % 6 END AS declared_bands", "p_size % 5 AS c", "p_size % 4 AS w", "CASE p_partkey % 4 WHEN 0 THEN 'NM ' WHEN 1 THEN 'um' WHEN 2 THEN 'furlong' END AS unit")
    of = lambda n, value, unit: F.when(F.col(n) > 0, F.transform(F.sequence(F.lit(0), F.col(n) - 1), lambda i: F.struct(value(i).cast("double").alias("value"), unit.alias("unit"))))
    rows = p.select("label_id", "declared_bands", of("c", lambda i: i + 500, F.col("unit")).alias("centers"), of("w", lambda i: F.lit(10.0), F.lit("nm")).alias("widths"), F.array(F.lit(True), F.lit(False)).alias("bad_bands"))
    return refine.label_bands(rows).withColumn("warnings", F.array_join("warnings", ","))


# --- sub-pixel refinement ----------------------------------------------------------------------------------------

#: Images of a few bumps, one a nation: heights come from the table, and the reference is the same pattern moved by a planted fraction of a pixel. The last
#: images are flat. Points come from the suppliers, near the bumps or too near an edge, with a seed that is off by up to half a pixel.
_PLANTED = "n_nationkey AS image_id, n_regionkey AS region, (n_nationkey * 7 % 19 - 9) / 20.0e0 AS dy, (n_nationkey * 5 % 17 - 8) / 20.0e0 AS dx, n_nationkey >= 23 AS flat"
def _bump(y: float, x: float, height: str) -> str:
    return f"({height}) * exp(-(({{y}} - {24 + y}e0) * ({{y}} - {24 + y}e0) + ({{x}} - {24 + x}e0) * ({{x}} - {24 + x}e0)) / 4.5e0)"


_BUMPS = ((0.0, 0.0, "1.0e0"), (2.2, -1.5, "0.7e0 - 0.05e0 * (image_id % 5)"), (-1.8, 1.9, "-0.6e0"), (-2.0, -2.4, "0.4e0 + 0.03e0 * (image_id % 4)"))
_PATTERN = f"CASE WHEN flat THEN 1.0e0 ELSE 3.0e0 + {' + '.join(_bump(*b) for b in _BUMPS)} END"
_SEEDED = "s_suppkey AS point_id, s_nationkey AS image_id, s_nationkey AS ref_image_id, CAST(CASE WHEN s_suppkey % 10 = 3 THEN 6 ELSE 23 + s_suppkey % 3 END AS DOUBLE) AS line, CAST(23 + s_suppkey % 7 % 3 AS DOUBLE) AS sample"


def _planted(spark, d):
    """Source and reference pixels, points with their planted shift."""
    images = _t(spark, d, "nation").selectExpr(*_PLANTED.replace("e0", "D").split(", "))
    grid = images.selectExpr("*", "explode(sequence(0L, 47L)) AS line").selectExpr("*", "explode(sequence(0L, 47L)) AS sample")

    def drawn(y, x):
        return grid.selectExpr("image_id", "line", "sample", f"{_PATTERN.format(y=y, x=x).replace('e0', 'D')} AS value", "(line + sample) % 11 > 0 AS valid")

    points = _t(spark, d, "supplier").selectExpr(*_SEEDED.split(", "))
    points = points.join(F.broadcast(images.select("image_id", "dy", "dx")), "image_id")  # a row a nation
    return drawn("line", "sample"), drawn("line - dy", "sample - dx"), points.withColumns({"ref_line": F.col("line"), "ref_sample": F.col("sample")})


_CUT = f"""WITH im AS (SELECT {_PLANTED} FROM nation), g AS (SELECT im.*, l.i AS line, s.i AS sample FROM im, range(48) l(i), range(48) s(i)),
    px AS (SELECT image_id, line, sample, {_PATTERN.format(y="line", x="sample")} AS a, {_PATTERN.format(y="line - dy", x="sample - dx")} AS b FROM g),
    pt AS (SELECT {_SEEDED} FROM supplier), j AS (SELECT pt.*, dy, dx, flat, line >= 8 AND line <= 39 AS inside FROM pt JOIN im ON im.image_id = pt.image_id)"""


@query(f"""{_CUT} SELECT point_id, CASE WHEN NOT inside THEN 'refinement patch extraction failed: source out_of_bounds; reference out_of_bounds' WHEN flat THEN 'refinement skipped: low patch texture' END AS rejection_reason,
    CASE WHEN inside AND NOT flat THEN round(dy, 2) END AS planted_line, CASE WHEN inside AND NOT flat THEN round(dx, 2) END AS planted_sample, CASE WHEN inside AND NOT flat THEN true END AS ecc_near, CASE WHEN inside AND NOT flat THEN true END AS fourier_near,
    CASE WHEN inside AND NOT flat THEN true END AS refined_near, CASE WHEN inside AND NOT flat THEN 2 ELSE 0 END::INT AS estimators, CASE WHEN inside AND NOT flat THEN true END AS agreed, CASE WHEN inside AND NOT flat THEN true END AS has_covariance FROM j""")
def correspondences_refined(spark, d):
    """Enhanced correlation finds each planted shift to 0.02 px, the upsampled peak and their mean to its grid."""
    source, reference, points = _planted(spark, d)
    rows = subpixel.refine_correspondences(points, source, reference, 8, 1e-6, noise_variance=F.lit(0.01))
    off = lambda a, b: F.hypot(F.col(a) - F.col("dy"), F.col(b) - F.col("dx"))
    ran = F.col("rejection_reason").isNull()
    moved = F.hypot(F.col("refined_line") - F.col("coarse_line") - F.col("dy"), F.col("refined_sample") - F.col("coarse_sample") - F.col("dx"))
    return rows.select(
        "point_id", "rejection_reason", F.when(ran, _r(F.col("dy"), 2)).alias("planted_line"), F.when(ran, _r(F.col("dx"), 2)).alias("planted_sample"),
        F.when(ran, off("ecc_line", "ecc_sample") <= 0.02).alias("ecc_near"), F.when(ran, off("fourier_line", "fourier_sample") <= 0.15).alias("fourier_near"), F.when(ran, moved <= 0.1).alias("refined_near"),
        F.size("estimators").alias("estimators"), F.when(ran, F.col("estimator_disagreement_px") <= 0.17).alias("agreed"), F.when(ran, F.col("covariance").isNotNull()).alias("has_covariance"),
    )


@query(f"""{_CUT}, k AS (SELECT point_id, px.line - pt.line AS y, px.sample - pt.sample AS x, a, b FROM (SELECT pt.* FROM pt JOIN j USING (point_id) WHERE inside AND NOT flat) pt JOIN px ON px.image_id = pt.image_id AND px.line BETWEEN pt.line - 8 AND pt.line + 8 AND px.sample BETWEEN pt.sample - 8 AND pt.sample + 8),
    s AS (SELECT point_id, a, b, CASE y WHEN -8 THEN lead(a) OVER v - a WHEN 8 THEN a - lag(a) OVER v ELSE (lead(a) OVER v - lag(a) OVER v) / 2 END AS gy, CASE x WHEN -8 THEN lead(a) OVER h - a WHEN 8 THEN a - lag(a) OVER h ELSE (lead(a) OVER h - lag(a) OVER h) / 2 END AS gx
        FROM k WINDOW v AS (PARTITION BY point_id, x ORDER BY y), h AS (PARTITION BY point_id, y ORDER BY x)),
    m AS (SELECT point_id, a - avg(a) OVER p AS t, b - avg(b) OVER p AS w, gy - avg(gy) OVER p AS gy, gx - avg(gx) OVER p AS gx FROM s WINDOW p AS (PARTITION BY point_id)),
    q AS (SELECT point_id, sqrt(sum(t * t)) AS nt, sqrt(sum(w * w)) AS nw, sum(t * w) AS tw, sum(gy * gy) AS yy, sum(gy * gx) AS yx, sum(gx * gx) AS xx, sum(gy * t) AS yt, sum(gx * t) AS xt, sum(gy * w) AS yw, sum(gx * w) AS xw FROM m GROUP BY 1),
    e AS (SELECT point_id, yy - yw * yw / (nw * nw) AS a, yx - yw * xw / (nw * nw) AS b, xx - xw * xw / (nw * nw) AS c, nw * yt / nt - tw / nt / nw * yw AS r, nw * xt / nt - tw / nt / nw * xw AS u FROM q)
    SELECT point_id, round((c * r - b * u) / (a * c - b * b), 6) AS step_line, round((a * u - b * r) / (a * c - b * b), 6) AS step_sample FROM e""")
def alignment_first_step(spark, d):
    """One Gauss-Newton step from the seed, by the normal equations."""
    source, reference, points = _planted(spark, d)
    _, pairs = subpixel.patch_pairs(points.where("image_id < 23"), source, reference, 8, 0.5)
    rows = subpixel.refine_ecc(pairs, iterations=1)
    return rows.select("point_id", _r(F.col("ecc_line")).alias("step_line"), _r(F.col("ecc_sample")).alias("step_sample"))


# --- tiled and structural matching -------------------------------------------------------------------------------

#: The reference is the source two lines down and a sample to the left; tiles of 24 pixels with halos of 8, the reference's windows moved likewise.
_TILES = """t AS (SELECT h.image_id, r, c, greatest(r * 24 - 8, 0) AS l0, least(r * 24 + 32, h) AS l1, greatest(c * 24 - 8, 0) AS s0, least(c * 24 + 32, w) AS s1 FROM h, range(2) a(r), range(3) b(c) WHERE r * 24 < h),
    p AS (SELECT t.*, l0 + 8 * i AS line, s0 + 8 * j AS sample FROM t, range(6) a(i), range(6) b(j) WHERE 8 * i >= 2 AND 8 * j >= 2 AND l0 + 8 * i + 2 < l1 AND s0 + 8 * j + 2 < s1),
    q AS (SELECT p.*, count(*) FILTER (d.valid) OVER () AS n FROM p JOIN d ON d.image_id = p.image_id AND d.line BETWEEN p.line - 2 AND p.line + 2 AND d.sample BETWEEN p.sample - 2 AND p.sample + 2)"""


def _two_line_images(spark, d):
    p = dense_pixels(spark, d).where("line < 48").select(F.col("image_id").alias("pair_id"), F.lit(0).alias("level"), "line", "sample", "value", F.lit(True).alias("valid"))
    return p, p.withColumns({"line": F.col("line") + 2, "sample": F.col("sample") - 1})


@query(f"""WITH {_DENSE}, g AS (SELECT image_id, least(h, 48) AS h, w FROM h), {_TILES.replace("h.image_id", "g.image_id").replace("FROM h,", "FROM g,").split(", q AS")[0].rstrip().rstrip(",")},
    k AS (SELECT image_id AS job_id, 'r' || lpad(r::VARCHAR, 4, '0') || 'c' || lpad(c::VARCHAR, 4, '0') AS tile_id, line, sample, lpad((line - l0)::VARCHAR, 6, '0') || ':' || lpad((sample - s0)::VARCHAR, 6, '0') AS place FROM p),
    w AS (SELECT *, first_value(tile_id || ':' || place) OVER (PARTITION BY job_id, line, sample ORDER BY tile_id) AS win, first_value(tile_id) OVER (PARTITION BY job_id, line, sample ORDER BY tile_id) AS win_tile FROM k)
    SELECT job_id, tile_id, tile_id || ':' || place AS match_id, line, sample, line + 2.0e0 AS ref_line, sample - 1.0e0 AS ref_sample, win_tile = tile_id AS is_candidate,
    CASE WHEN win_tile <> tile_id THEN 'tiled overlap duplicate; retained ' || win_tile || ':' || win || ' by deterministic score order' END AS rejection_reason FROM w""")
def tiles_matched(spark, d):
    """Every grid point of every tile finds its place; points of several tiles stay once."""
    source, reference = _two_line_images(spark, d)
    levels = source.groupBy("pair_id", "level").agg((F.max("line") + 1).alias("lines"), (F.max("sample") + 1).alias("samples"))
    tiles = tiling.plan_tiles(levels, 24, 8).withColumns({"ref_origin_line": F.col("origin_line") + 2, "ref_origin_sample": F.col("origin_sample") - 1})
    rows = tiling.match_tiles(source, reference, tiles, lambda s, r, p: matching.ncc_search(s, r, 8, 2, 1.5, priors=p), budget_bytes=1 << 20)
    return rows.select("job_id", "tile_id", "match_id", "line", "sample", "ref_line", "ref_sample", "is_candidate", "rejection_reason")


@query(f"""WITH {_DENSE}, k AS (SELECT t.image_id, t.line, t.sample, h, w FROM d t JOIN h ON h.image_id = t.image_id WHERE t.line % 8 = 0 AND t.sample % 8 = 0 AND t.line >= 2 AND t.sample >= 2 AND t.line + 2 < h AND t.sample + 2 < w)
    SELECT image_id, line, sample, true AS is_candidate, CASE WHEN line >= 4 AND sample >= 4 AND line + 4 < h AND sample + 4 < w THEN line + 1.0e0 END AS ref_line, CASE WHEN line >= 4 AND sample >= 4 AND line + 4 < h AND sample + 4 < w THEN sample + 2.0e0 END AS ref_sample FROM k""")
def reversed_contrast_matched(spark, d):
    """Gradients find a reference of reversed contrast (correlation of values would be -1 there); points near an edge, whose slopes are one-sided, are only counted."""
    p = dense_pixels(spark, d).withColumn("valid", F.lit(True))
    moved = p.select("image_id", (F.col("line") + 1).alias("line"), (F.col("sample") + 2).alias("sample"), (3 - 2 * F.col("value")).alias("value"), "valid")
    size = p.groupBy("image_id").agg((F.max("line") + 1).alias("h"), (F.max("sample") + 1).alias("w"))
    rows = matching.structural_search(p, moved, 8, 2, 3.0).join(F.broadcast(size), "image_id")  # a row an image
    inner = "line >= 4 and sample >= 4 and line + 4 < h and sample + 4 < w"
    return rows.select("image_id", "line", "sample", "is_candidate", F.expr(f"case when {inner} then ref_line end").alias("ref_line"), F.expr(f"case when {inner} then ref_sample end").alias("ref_sample"))


# --- whole tiles and paired pyramids -----------------------------------------------------------------------------


@query(f"""WITH {_DENSE} SELECT image_id AS tile_id, CASE WHEN image_id % 5 = 4 THEN 'no_valid_pixel' ELSE 'ok' END AS status, CASE WHEN image_id % 5 < 4 THEN 3.0e0 END AS dy, CASE WHEN image_id % 5 < 4 THEN -2.0e0 END AS dx, CASE WHEN image_id % 5 < 4 THEN (h - 1) / 2 + 3 END AS ref_line,
    CASE WHEN image_id % 5 < 4 THEN (w - 1) / 2 - 2 END AS ref_sample, CASE WHEN image_id % 5 < 4 THEN true END AS sure, CASE WHEN image_id % 2 = 0 AND image_id % 5 < 4 THEN round(sqrt(2), 6) END AS residual FROM h""")
def tiles_phase_correlated(spark, d):
    """The reference is the tile turned round by three lines and two samples; every other tile has a prior near that, one in five has no valid pixel."""
    p = dense_pixels(spark, d).select("image_id", "line", "sample", "value")
    size = p.groupBy("image_id").agg((F.max("line") + 1).alias("h"), (F.max("sample") + 1).alias("w"))
    turned = p.join(F.broadcast(size), "image_id").select("image_id", F.pmod(F.col("line") + 3, "h").alias("line"), F.pmod(F.col("sample") - 2, "w").alias("sample"), F.col("value").alias("reference"))  # a row an image
    tiles = p.withColumnRenamed("value", "source").join(turned, ["image_id", "line", "sample"]).withColumnRenamed("image_id", "tile_id")
    tiles = tiles.withColumns({"source_valid": F.col("tile_id") % 5 < 4, "reference_valid": F.lit(True)})
    priors = size.where("image_id % 2 = 0").select(F.col("image_id").alias("tile_id"), F.lit(2.0).alias("prior_line"), F.lit(-1.0).alias("prior_sample"), F.lit(3.0).alias("radius"))
    rows = matching.phase_correlation(tiles, priors)
    return rows.select("tile_id", "status", "dy", "dx", "ref_line", "ref_sample", F.when(F.col("dy").isNotNull(), F.col("score") > 10).alias("sure"), _r(F.col("residual")).alias("residual"))


def _resampled_sql(ratio: int, lines: int, samples: int) -> str:
    """SQL of images cut to lines x samples on a grid of pixels `ratio` times as large: an even ratio samples between the two middle pixels of each block."""
    cut = f"d AS (SELECT * FROM dd WHERE line < {lines} AND sample < {samples}), h AS (SELECT image_id, max(line) + 1 AS h, max(sample) + 1 AS w FROM d GROUP BY 1)"
    base = _DENSE.split(",\n    h AS")[0].replace("d AS (", "dd AS (", 1)
    if ratio == 1:
        return f"SELECT image_id, line, sample, value, valid FROM (WITH {base}, {cut} SELECT * FROM d)"
    mid = f"% {ratio} IN ({ratio // 2 - 1}, {ratio // 2})"
    return f"""SELECT image_id, line, sample, value, valid FROM (WITH {base}, {cut}, {_blur_sql(0.5 * (ratio * ratio - 1) ** 0.5)} SELECT image_id, line // {ratio} AS line, sample // {ratio} AS sample, avg(value) FILTER (line {mid} AND sample {mid}) AS value, bool_and(valid) AS valid FROM b GROUP BY 1, 2, 3)"""


@query(" UNION ALL ".join(f"SELECT {level} AS level, '{side}' AS side, image_id, line, sample, round(value, 6) AS value, valid FROM ({_resampled_sql(r, n, m)})" for level, side, r, n, m in ((0, "source", 2, 16, 64), (0, "reference", 1, 8, 32), (1, "source", 4, 16, 64), (1, "reference", 2, 8, 32))))
def paired_pyramids(spark, d):
    """Sources of half a metre, references of one: two common levels."""
    p = dense_pixels(spark, d)
    rows, _ = pyramid.paired_pyramid(p.where("line < 16"), p.where("line < 8 and sample < 32"), 0.5, 1.0, 2)
    return rows.withColumn("value", _r(F.col("value")))
