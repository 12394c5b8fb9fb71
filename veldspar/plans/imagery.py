"""Queries of feature channels, shadows and matcher channels over the test tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from veldspar.operators import raster
from veldspar.plans.registry import _DENSE, PIXEL_SQL, _r, dense_pixels, pixels, query

@query(f"""WITH {_DENSE}, s AS (SELECT image_id, line, sample, bool_and(ok) AS support, count(*) AS n FROM (SELECT a.image_id, a.line, a.sample, o.valid AS ok FROM d a JOIN d o ON o.image_id = a.image_id AND o.line BETWEEN a.line - 2 AND a.line + 2 AND o.sample BETWEEN a.sample - 2 AND a.sample + 2) GROUP BY 1, 2, 3)
    SELECT image_id, line, sample, support AND n = 25 AS support FROM s""")
def square_support(spark, d):
    return raster.square_support(dense_pixels(spark, d), 2).select("image_id", "line", "sample", "support")


@query()  # SQL would join 40 offsets of nine pixels for each pixel; a test compares it with a plain version
def self_similarity_channel(spark, d):
    rows = raster.self_similarity(dense_pixels(spark, d))
    return rows.select("image_id", "line", "sample", _r(F.col("self_similarity")).alias("self_similarity"))


_QUANTILES = f"""WITH p AS (SELECT *, value AS raw FROM ({PIXEL_SQL})), a AS (SELECT image_id, max(abs(value)) AS amp, count(*) AS n FROM p WHERE valid GROUP BY 1), v AS (SELECT p.image_id, value / amp AS v FROM p JOIN a USING (image_id) WHERE valid),
    s AS (SELECT image_id, quantile_cont(v, 0.05) AS sh, quantile_cont(v, 0.2) AS pe, quantile_cont(v, 0.5) AS me, quantile_cont(v, 0.95) AS hi, min(v) AS mi FROM v GROUP BY 1),
    m AS (SELECT image_id, quantile_cont(abs(v - me), 0.5) AS mad FROM v JOIN s USING (image_id) GROUP BY 1), t AS (SELECT v.image_id, v, CASE WHEN sh = mi THEN v = mi ELSE v < sh END AS k FROM v JOIN s USING (image_id)),
    e AS (SELECT image_id, max(v) FILTER (k) AS ld, min(v) FILTER (NOT k) AS nx FROM t GROUP BY 1), b AS (SELECT *, coalesce(nx - ld, 0) AS gap, coalesce(me - ld, 0) AS below, coalesce(hi - ld, 0) AS span FROM a JOIN s USING (image_id) JOIN m USING (image_id) JOIN e USING (image_id)),
    g AS (SELECT *, CASE WHEN n < 32 THEN 'no_confident_shadow:insufficient_valid_samples' WHEN span <= 2.3e-308 THEN 'no_confident_shadow:constant_or_insufficient_distribution' WHEN (mad > 0 AND below > 0 AND below / mad >= 2.4) OR (gap > 0 AND gap / span >= 0.5) THEN 'ok' ELSE 'no_confident_shadow:no_separated_dark_tail' END AS status,
        mad > 0 AND below > 0 AND below / mad >= 2.4 AS robust, gap > 0 AND gap / span >= 0.5 AS discrete FROM b)"""


@query(f"{_QUANTILES} SELECT image_id, round(sh, 6) AS shadow, round(pe, 6) AS penumbra, round(me, 6) AS median, round(mad, 6) AS mad, status, CASE WHEN n >= 32 AND span > 2.3e-308 THEN robust END AS robust_tail, CASE WHEN n >= 32 AND span > 2.3e-308 THEN discrete END AS discrete_tail FROM g")
def shadow_decisions(spark, d):
    rows = raster.shadow_decisions(pixels(spark, d), mad_times=2.4)
    return rows.select("image_id", *[_r(F.col(c)).alias(c) for c in ("shadow", "penumbra", "median", "mad")], "status", "robust_tail", "discrete_tail")


@query(f"""{_QUANTILES}, x AS (SELECT p.image_id, line, sample, valid, raw / amp AS v, sh, pe, mi, status, span > 2.3e-308 AND n >= 32 AND pe > sh AS wide FROM p JOIN g USING (image_id)), k AS (SELECT *, valid AND status = 'ok' AND CASE WHEN sh = mi THEN v = mi ELSE v < sh END AS dark,
    valid AND wide AND CASE WHEN pe = mi THEN v = mi ELSE v < pe END AS half FROM x) SELECT image_id, line, sample, dark AS shadow, half AND NOT dark AS penumbra, round(CASE WHEN dark THEN 1 WHEN half THEN least(0.75, greatest(0.25, 0.25 + 0.5 * (pe - v) / (pe - sh))) ELSE 0 END, 6) AS confidence FROM k""")
def shadow_masks(spark, d):
    return raster.shadows(pixels(spark, d), mad_times=2.4).select("image_id", "line", "sample", "shadow", "penumbra", _r(F.col("confidence")).alias("confidence"))


def _z(src: str, ok: str, name: str, table: str) -> str:
    return f"{name}_s AS (SELECT image_id, avg({src}) FILTER ({ok}) AS m, stddev_pop({src}) FILTER ({ok}) AS dv FROM {table} GROUP BY 1), {name}_t AS (SELECT {table}.*, CASE WHEN {ok} AND dv > 2.3e-16 THEN ({src} - m) / dv ELSE 0 END AS {name} FROM {table} JOIN {name}_s ON {name}_s.image_id = {table}.image_id)"


def _slope(axis: str, other: str, table: str, name: str) -> str:
    w = f"(PARTITION BY image_id, {other} ORDER BY {axis})"
    return f"""{name}_w AS (SELECT *, lag(normalised) OVER {w} AS vb, lead(normalised) OVER {w} AS va, lag(valid) OVER {w} AS ob, lead(valid) OVER {w} AS oa FROM {table}),
    {name}_d AS (SELECT * EXCLUDE (vb, va, ob, oa), coalesce(CASE WHEN ob IS NULL THEN valid AND oa WHEN oa IS NULL THEN valid AND ob ELSE valid AND ob AND oa END, false) AS {name}_ok, CASE WHEN ob IS NULL THEN va - normalised WHEN oa IS NULL THEN normalised - vb ELSE (va - vb) * 0.5 END AS {name}_v FROM {name}_w)"""


_CHANNELS = f"""WITH {_DENSE}, {_z('value', 'valid', 'normalised', 'd')}, {_slope('line', 'sample', 'normalised_t', 'l')}, {_z('l_v', 'l_ok', 'd_line', 'l_d')}, {_slope('sample', 'line', 'd_line_t', 's')}, {_z('s_v', 's_ok', 'd_sample', 's_d')},
    mg AS (SELECT *, sqrt(d_line ** 2 + d_sample ** 2) AS mag FROM d_sample_t), {_z('mag', 'l_ok AND s_ok', 'magnitude', 'mg')},
    bx AS (SELECT a.image_id, a.line, a.sample, coalesce(avg(o.normalised) FILTER (o.valid), 0) AS mean FROM magnitude_t a JOIN magnitude_t o ON o.image_id = a.image_id AND abs(o.line - a.line) <= 1 AND abs(o.sample - a.sample) <= 1 GROUP BY 1, 2, 3),
    cn AS (SELECT magnitude_t.*, normalised - mean AS off FROM magnitude_t JOIN bx ON bx.image_id = magnitude_t.image_id AND bx.line = magnitude_t.line AND bx.sample = magnitude_t.sample), {_z('off', 'valid', 'contrast', 'cn')}"""
_NAMES = ("normalised", "d_line", "d_sample", "magnitude", "contrast")


@query(f"{_CHANNELS} SELECT image_id, line, sample, {', '.join(f'round(CASE WHEN valid THEN {c} ELSE 0 END, 5) AS {c}' for c in _NAMES)} FROM contrast_t")
def learned_channels(spark, d):
    rows = raster.learned_channels(dense_pixels(spark, d))
    return rows.select("image_id", "line", "sample", *[_r(F.col(c), 5).alias(c) for c in _NAMES])
