"""Queries of tie-point verification, coverage and scene evidence over the test tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from veldspar.operators import coverage, gates, tiepoints
from veldspar.plans.registry import _AFFINE, _CELLS, _FB, _GREEDY, _HULL, PIXEL_SQL, TIE_SQL, _r, _selected, _t, pixels, query, ties

# --- verification ------------------------------------------------------------------------------------------------

_TILED = f"""SELECT *, CASE WHEN score > 5 THEN 't' || cast(cast(score AS bigint) % 4 AS varchar) ELSE '' END AS tile_id, cast(residual_px * 10 AS bigint) % 3 AS level, score % 9 <> 0 AS live FROM ({TIE_SQL})"""


def tiled(spark, d):
    rows = ties(spark, d).withColumn("tile_id", F.when(F.col("score") > 5, F.concat(F.lit("t"), (F.col("score").cast("long") % 4).cast("string")))).withColumn("level", (F.col("residual_px") * 10).cast("long") % 3)
    return rows.withColumn("is_candidate", F.lit(True)).withColumn("rejection_reason", F.when(F.col("score") % 9 == 0, "known before"))


@query(_GREEDY.format(rows=_TILED.replace("cast(residual_px * 10 AS bigint)", "trunc(residual_px * 10)::BIGINT"), order="score DESC, level, tile_id, match_id", near="greatest(sqrt((w.l - line) ** 2 + (w.s - sample) ** 2), sqrt((w.rl - ref_line) ** 2 + (w.rs - ref_sample) ** 2)) <= 60") + """,
    x AS (SELECT t.job_id, t.match_id, live, list_contains(list_transform(won, lambda w: w.m), match_id) AS ok, list_filter(won, lambda w: greatest(sqrt((w.l - line) ** 2 + (w.s - sample) ** 2), sqrt((w.rl - ref_line) ** 2 + (w.rs - ref_sample) ** 2)) <= 60)[1] AS w FROM t LEFT JOIN f ON f.job_id = t.job_id)
    SELECT job_id, match_id, CASE WHEN NOT live THEN 'known before' WHEN NOT ok THEN 'tiled overlap duplicate; retained ' || CASE WHEN w.t = '' THEN 'untiled' ELSE w.t END || ':' || w.m || ' by deterministic score order' END AS rejection_reason, NOT live OR ok AS is_candidate FROM x""")
def tile_duplicates_marked(spark, d):
    return tiepoints.tile_duplicates(tiled(spark, d), 60.0).select("job_id", "match_id", "rejection_reason", "is_candidate")


@query(f"""WITH t AS ({_TILED.replace("cast(residual_px * 10 AS bigint)", "trunc(residual_px * 10)::BIGINT")}) SELECT job_id, match_id, line + level * 100 AS line, sample + cast(right(tile_id, 1) AS bigint) * 10 AS sample, ref_line + level * 100 + 1 AS ref_line, ref_sample + cast(right(tile_id, 1) AS bigint) * 10 - 1 AS ref_sample FROM t WHERE tile_id <> ''""")
def tiles_in_level_frame(spark, d):
    at = spark.range(12).selectExpr("id div 4 AS level", "'t' || cast(id % 4 AS string) AS tile_id", "(id div 4) * 100D AS origin_line", "(id % 4) * 10D AS origin_sample", "(id div 4) * 100D + 1 AS ref_origin_line", "(id % 4) * 10D - 1 AS ref_origin_sample")
    return tiepoints.in_level_frame(tiled(spark, d), at).select("job_id", "match_id", "line", "sample", "ref_line", "ref_sample")


@query()
def verified_candidates(spark, d):
    t = ties(spark, d)
    rev = t.where("score > 10").selectExpr("job_id", "'r' || match_id AS rev_id", "ref_line + 1 AS ref_line", "ref_sample", "line + 2 AS line", "sample - 1 AS sample")
    rows = tiepoints.verify_candidates(t, rev, 5.0, 20.0, 60.0, 3.0, seed=7)
    return rows.select("job_id", "match_id", "nms_status", _r(F.col("forward_backward_error_px")).alias("forward_backward_error_px"), _r(F.col("residual_px"), 4).alias("residual_px"), "is_inlier", "rejection_reason")


@query(f"{_FB}, y AS (SELECT job_id, match_id, CASE WHEN trip IS NULL THEN 'no_reverse_match' WHEN trip > 2.5 THEN 'round_trip_exceeded' END AS why FROM x) SELECT job_id, match_id, why AS early_reason, why IS NULL AS reaches_fit FROM y".replace("b.m[2]", "struct_extract(b.m, 2)"))
def match_candidates_verified(spark, d):
    rows = tiepoints.verify_match_candidates(ties(spark, d), _reverse(spark, d), 2.5, 3.0, anchor=3.0)
    early = F.when(F.col("rejection_reason").isin("no_reverse_match", "round_trip_exceeded"), F.col("rejection_reason"))
    return rows.select("job_id", "match_id", early.alias("early_reason"), early.isNull().alias("reaches_fit"))


def _reverse(spark, d):
    return ties(spark, d).where("score > 10").selectExpr("job_id", "'r' || match_id AS rev_id", "ref_line + 1 AS ref_line", "ref_sample", "line + 2 AS line", "sample - 1 AS sample")


@query(f"""WITH t AS ({TIE_SQL}), {_AFFINE.format(key='job_id', rows='t')}, r AS (SELECT t.job_id, sqrt(avg((u_line * line + u_sample * sample + u_shift - ref_line) ** 2 + (v_line * line + v_sample * sample + v_shift - ref_sample) ** 2)) AS rms FROM t JOIN fit USING (job_id) GROUP BY 1),
    q AS (SELECT fit.*, sqrt(rms * rms + 0.3) AS unc FROM fit JOIN r USING (job_id)) SELECT job_id, n, CASE WHEN u_line IS NULL THEN 'too_few_samples' ELSE 'ok' END AS status, round(u_shift, 4) AS shift_line, round(v_shift, 4) AS shift_sample,
    round(sqrt(u_line ** 2 + v_line ** 2), 6) AS scale_line, round(sqrt(u_sample ** 2 + v_sample ** 2), 6) AS scale_sample, round(degrees(atan2(v_line, u_line)), 4) AS orientation_deg, round(unc, 5) AS uncertainty_px,
    round(degrees(atan2(unc, greatest(1e-12, sqrt(u_line ** 2 + v_line ** 2)))), 4) AS orientation_uncertainty_deg, 'supplied_projection_covariances' AS provenance FROM q""")
def warp_priors(spark, d):
    rows = tiepoints.warp_prior(ties(spark, d), ["job_id"], 0.1, 0.2)
    digits = {"shift_line": 4, "shift_sample": 4, "scale_line": 6, "scale_sample": 6, "orientation_deg": 4, "uncertainty_px": 5, "orientation_uncertainty_deg": 4}
    return rows.select("job_id", "n", "status", *[_r(F.col(c), n).alias(c) for c, n in digits.items()], "provenance")


# --- coverage ----------------------------------------------------------------------------------------------------

_GRID = "SELECT r AS \"row\", c AS col, (r * 3 + c * 5) % 7 <> 0 AS eligible FROM range(8) a(r), range(8) b(c)"
_COVERAGE = f"""{_CELLS.replace('WITH t', 'WITH RECURSIVE t')}, k AS (SELECT * FROM s WHERE selected), {_HULL.format(rows='k')}, gr AS ({_GRID}), el AS (SELECT count(*) AS cells FROM gr WHERE eligible),
    oc AS (SELECT job_id, count(*) AS picked, count(DISTINCT ("row", col)) AS occupied FROM k GROUP BY 1), jb AS (SELECT DISTINCT job_id FROM t),
    em AS (SELECT jb.job_id, gr."row" AS y, gr.col AS x FROM jb CROSS JOIN gr WHERE eligible AND NOT EXISTS (SELECT 1 FROM k WHERE k.job_id = jb.job_id AND k."row" = gr."row" AND k.col = gr.col)),
    rg(job_id, y, x, root) AS (SELECT job_id, y, x, y * 8 + x FROM em UNION SELECT e.job_id, e.y, e.x, rg.root FROM rg JOIN em e ON e.job_id = rg.job_id AND abs(e.y - rg.y) + abs(e.x - rg.x) = 1),
    ls AS (SELECT job_id, y, x, min(root) AS root FROM rg GROUP BY 1, 2, 3), lr AS (SELECT job_id, max(n) AS run FROM (SELECT job_id, root, count(*) AS n FROM ls GROUP BY 1, 2) GROUP BY 1),
    cov AS (SELECT jb.job_id, el.cells AS eligible_cells, coalesce(occupied, 0) / cells::DOUBLE AS occupancy, CASE WHEN picked >= 3 THEN coalesce(area, 0) / (cells * 16384.0e0) END AS hull_ratio, coalesce(run, 0) AS largest_empty_run
        FROM jb CROSS JOIN el LEFT JOIN oc ON oc.job_id = jb.job_id LEFT JOIN hull ON hull.job_id = jb.job_id LEFT JOIN lr ON lr.job_id = jb.job_id)"""


def _grid(spark):
    return spark.range(64).selectExpr("cast(id div 8 AS int) AS row", "cast(id % 8 AS int) AS col", "((id div 8) * 3 + (id % 8) * 5) % 7 <> 0 AS eligible")


@query(f"{_COVERAGE} SELECT job_id, eligible_cells, round(occupancy, 6) AS occupancy, round(hull_ratio, 6) AS hull_ratio, largest_empty_run::BIGINT AS largest_empty_run FROM cov")
def coverage_metrics(spark, d):
    rows = coverage.coverage_metrics(_selected(spark, d), _grid(spark), 1024, 1024)
    return rows.select("job_id", "eligible_cells", _r(F.col("occupancy")).alias("occupancy"), _r(F.col("hull_ratio")).alias("hull_ratio"), "largest_empty_run")


@query(f"{_CELLS} SELECT job_id, \"row\", col, count(*) AS n FROM s WHERE is_inlier GROUP BY 1, 2, 3")
def coverage_cell_counts(spark, d):
    return coverage.cell_counts(ties(spark, d), 1024, 1024)


@query(f"""WITH p AS ({PIXEL_SQL}), h AS (SELECT image_id, max(line) + 1 AS h, max(sample) + 1 AS w FROM p GROUP BY 1), g AS (SELECT image_id, h, w, r, c FROM h, range(8) a(r), range(8) b(c)),
    e AS (SELECT g.image_id, r, c, bool_or(valid) AS s, bool_or(value > -0.1) AS q FROM g JOIN p ON p.image_id = g.image_id AND line >= r * h // 8 AND line < (r + 1) * h // 8 AND sample >= c * w // 8 AND sample < (c + 1) * w // 8 GROUP BY 1, 2, 3)
    SELECT g.image_id, g.r::INT AS "row", g.c::INT AS col, coalesce(s AND q, false) AS eligible, CASE WHEN NOT coalesce(s AND q, false) THEN 'source or normalized reference grid cell has no usable local pixels' END AS exclusion_reason FROM g LEFT JOIN e ON e.image_id = g.image_id AND e.r = g.r AND e.c = g.c""")
def local_eligibility(spark, d):
    p = pixels(spark, d)
    return coverage.local_eligibility(p, p.withColumn("valid", F.col("value") > -0.1))


@query("""WITH g AS (SELECT (p_partkey % 9)::INT AS "row", (p_size % 8)::INT AS col, p_partkey % 3 <> 0 AS eligible, CASE WHEN p_partkey % 5 = 0 THEN ' ' ELSE p_name END AS exclusion_reason FROM part WHERE p_partkey <= 40), n AS (SELECT *, count(*) OVER (PARTITION BY "row", col) AS n FROM g)
    SELECT * FROM (SELECT "row", col, eligible, exclusion_reason, CASE WHEN "row" > 7 THEN 'outside_grid' WHEN n > 1 THEN 'repeated_cell' WHEN NOT eligible AND trim(exclusion_reason) = '' THEN 'missing_reason' END AS violation FROM n) WHERE violation IS NOT NULL""")
def grid_violations(spark, d):
    g = _t(spark, d, "part").where("p_partkey <= 40").selectExpr("cast(p_partkey % 9 AS int) AS row", "cast(p_size % 8 AS int) AS col", "p_partkey % 3 <> 0 AS eligible", "CASE WHEN p_partkey % 5 = 0 THEN ' ' ELSE p_name END AS exclusion_reason")
    return coverage.grid_violations(g, 8, 8)


# --- scene evidence ----------------------------------------------------------------------------------------------

_EXTRA = {
    "is_candidate": "cast(score AS bigint) % 11 <> 0", "point_role": "CASE WHEN cast(score AS bigint) % 5 = 0 THEN 'withheld_check_point' ELSE 'fitting_inlier' END",
    "estimator_disagreement_px": "CASE WHEN cast(score AS bigint) % 4 <> 0 THEN score / 50 END", "has_covariance": "cast(score AS bigint) % 3 <> 0", "covariance_calibrated": "cast(score AS bigint) % 2 = 0", "refined": "cast(score AS bigint) % 7 <> 0",
}
_EXTRA_SQL = ", ".join(f"{e} AS {n}" for n, e in _EXTRA.items())


def _points(spark, d):
    rows = _selected(spark, d)
    return rows.withColumns({n: F.expr(e) for n, e in _EXTRA.items()}).withColumn("is_inlier", F.col("is_inlier") & F.col("is_candidate"))


@query(f"""{_COVERAGE}, pt AS (SELECT *, {_EXTRA_SQL} FROM s), ok AS (SELECT * REPLACE (is_inlier AND is_candidate AS is_inlier) FROM pt),
    m AS (SELECT job_id, count(*) FILTER (is_inlier) / nullif(count(*) FILTER (is_candidate), 0)::DOUBLE AS vf, max(estimator_disagreement_px) AS md, count(*) FILTER (is_inlier AND NOT has_covariance) / nullif(count(*) FILTER (is_inlier), 0)::DOUBLE AS iv,
        count(*) FILTER (is_inlier AND has_covariance AND NOT covariance_calibrated) / nullif(count(*) FILTER (is_inlier), 0)::DOUBLE AS uc, sqrt(avg(residual_px * residual_px) FILTER (point_role = 'withheld_check_point')) AS wr FROM ok GROUP BY 1)
    SELECT m.job_id, round(vf, 6) AS verified_inlier_fraction, round(md, 6) AS max_estimator_disagreement_px, round(iv, 6) AS invalid_covariance_fraction, round(uc, 6) AS uncalibrated_covariance_fraction, round(wr, 6) AS withheld_rmse_2d_px,
    round(occupancy, 6) AS eligible_occupancy, round(largest_empty_run / 64.0e0, 6) AS largest_empty_run_fraction FROM m JOIN cov USING (job_id)""")
def scene_evidence(spark, d):
    points = _points(spark, d)
    rows = gates.scene_evidence(points, coverage.coverage_metrics(_selected(spark, d), _grid(spark), 1024, 1024), 64)
    return rows.select("job_id", *[_r(F.col(c)).alias(c) for c in rows.columns if c != "job_id"])


@query(f"""{_CELLS}, pt AS (SELECT *, {_EXTRA_SQL} FROM s) SELECT job_id, count(*) FILTER (selected) AS attempted, count(*) FILTER (selected AND refined) AS refined, count(*) FILTER (selected AND refined AND has_covariance) AS covariances,
    count(*) FILTER (selected AND refined AND has_covariance AND covariance_calibrated) AS calibrated, count(*) FILTER (selected AND NOT refined) AS failed FROM pt GROUP BY 1""")
def refinement_counts(spark, d):
    return gates.refinement_counts(_points(spark, d))
