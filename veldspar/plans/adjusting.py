"""Queries of robust adjustment over the test tables, each with its SQL: a job is a part's line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from veldspar.operators import adjustment
from veldspar.plans.registry import _r, _t, query
from veldspar.tables import materialise

_ROWS = """r AS (SELECT l_partkey AS job_id, concat_ws('-', l_orderkey, l_linenumber, l_suppkey) AS match_id, l_linenumber = 7 AS held, min(l_quantity) AS line,
    min(l_tax) * 10 + 0.01e0 * min(l_quantity) AS ry, min(l_discount) * 10 - 0.5e0 AS rx FROM lineitem GROUP BY 1, 2, 3)"""


def _tables(spark, d, cov_xy: float):
    """Records and observations without their design; one job in forty has an uncalibrated record."""
    _t(spark, d, "lineitem").createOrReplaceTempView("adjusted_items")
    rows = materialise(spark.sql(f"WITH {_ROWS.replace('e0', 'D').replace('FROM lineitem', 'FROM adjusted_items')} SELECT * FROM r"))  # both tables are read from it
    records = rows.select(
        "job_id", "match_id", F.when(F.col("held"), adjustment.WITHHELD).otherwise(adjustment.FITTING).alias("role"), "line", F.lit(0.3).alias("cov_yy"), F.lit(cov_xy).alias("cov_xy"), F.lit(0.2).alias("cov_xx"),
        F.lit(adjustment.SOURCE_FRAME).alias("covariance_frame"), (F.col("job_id") % 40 != 7).alias("covariance_calibrated"),
    )
    return records, rows.select("job_id", "match_id", F.col("ry").alias("residual_y"), F.col("rx").alias("residual_x"), "line")


@query(f"""WITH {_ROWS}, m AS (SELECT job_id, avg(ry) AS y, avg(rx) AS x FROM r WHERE NOT held GROUP BY 1), e AS (SELECT r.job_id, held, (ry - y) ** 2 AS ey, (rx - x) ** 2 AS ex FROM r JOIN m ON m.job_id = r.job_id),
    g AS (SELECT job_id, count(*) FILTER (NOT held) AS n, count(*) FILTER (held) AS k, sqrt(avg(ey) FILTER (NOT held)) AS fy, sqrt(avg(ey + ex) FILTER (NOT held)) AS f2, sqrt(avg(ey + ex) FILTER (held)) AS c2 FROM e GROUP BY 1)
    SELECT m.job_id, m.job_id % 40 <> 7 AS accepted, CASE WHEN m.job_id % 40 = 7 THEN 'invalid_input' END AS rejection_reason, CASE WHEN m.job_id % 40 = 7 THEN 'covariance_uncalibrated' ELSE '' END AS problems, CASE WHEN m.job_id % 40 <> 7 THEN round(y, 9) END AS shift_line, CASE WHEN m.job_id % 40 <> 7 THEN round(x, 9) END AS shift_sample,
    CASE WHEN m.job_id % 40 <> 7 THEN n END AS fitted, CASE WHEN m.job_id % 40 <> 7 AND k > 0 THEN k END AS checked, CASE WHEN m.job_id % 40 <> 7 THEN round(fy, 9) END AS fit_rmse_y_px, CASE WHEN m.job_id % 40 <> 7 THEN round(f2, 9) END AS fit_rmse_2d_px, CASE WHEN m.job_id % 40 <> 7 THEN round(c2, 9) END AS check_rmse_2d_px FROM m JOIN g ON g.job_id = m.job_id""")
def adjusted_translations(spark, d):
    """All covariances are alike and no residual is far, so that the translation is the mean."""
    records, rows = _tables(spark, d, 0.1)
    design = F.array(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(1.0)))
    jobs = adjustment.fit_adjustment(records, rows.withColumn("design", design), adjustment.TRANSLATION, adjustment.Options(delta=1e9)).jobs
    p = lambda i: _r(F.get("p", F.lit(i)), 9)
    return jobs.select("job_id", "accepted", "rejection_reason", F.array_join("problems", ",").alias("problems"), p(0).alias("shift_line"), p(1).alias("shift_sample"), F.col("fit_n").alias("fitted"), F.col("check_n").alias("checked"), *(_r(F.col(c), 9).alias(c) for c in ("fit_rmse_y_px", "fit_rmse_2d_px", "check_rmse_2d_px")))


@query(f"""WITH {_ROWS}, m AS (SELECT job_id, regr_intercept(ry, line) AS a, regr_slope(ry, line) AS c, avg(rx) AS b FROM r WHERE NOT held AND job_id % 40 <> 7 GROUP BY 1)
    SELECT job_id, 'line,sample,drift' AS parameters, 'twice' AS dropped, 'rank_deficient:3' AS first_attempt, round(a, 8) AS line, round(b, 8) AS sample, round(c, 8) AS drift FROM m""")
def adjusted_drifts(spark, d):
    """The last optional parameter says the same as the one before, and leaves."""
    records, rows = _tables(spark, d, 0.0)
    zero, line = F.lit(0.0), F.col("line")
    design = F.array(F.array(F.lit(1.0), zero, line, 2 * line), F.array(zero, F.lit(1.0), zero, zero))
    names = [adjustment.Parameter("line", "px"), adjustment.Parameter("sample", "px"), adjustment.Parameter("drift", "px per line", True), adjustment.Parameter("twice", "px per line", True)]
    jobs = adjustment.fit_adjustment(records, rows.withColumn("design", design), names, adjustment.Options(delta=1e9, drop_optional=True)).jobs.where("accepted")
    first = F.get("attempts", F.lit(0))
    out = {k: _r(F.get("p", F.lit(i)), 8) for i, k in enumerate(("line", "sample", "drift"))}
    return jobs.select("job_id", F.array_join("parameters", ",").alias("parameters"), F.array_join("dropped", ",").alias("dropped"), F.concat_ws(":", first["reason"], first["rank"]).alias("first_attempt"), *(c.alias(k) for k, c in out.items()))


_REWEIGHTED = """WITH RECURSIVE {rows}, o AS (SELECT job_id, list(ry) FILTER (NOT held) AS y, list(rx) FILTER (NOT held) AS x FROM r WHERE job_id % 40 <> 7 GROUP BY 1),
    s(job_id, k, y, x, a, b) AS (SELECT job_id, 0, y, x, list_avg(y), list_avg(x) FROM o UNION ALL
        SELECT job_id, k + 1, y, x, list_sum(list_transform(w, lambda v, i: v * y[i])) / list_sum(w), list_sum(list_transform(w, lambda v, i: v * x[i])) / list_sum(w)
        FROM (SELECT *, list_transform(y, lambda v, i: least(1.0e0, 1.5e0 / greatest(1e-300, sqrt((v - a) ** 2 / 0.3e0 + (x[i] - b) ** 2 / 0.2e0)))) AS w FROM s) WHERE k < 60)
    SELECT job_id, round(a, 8) AS shift_line, round(b, 8) AS shift_sample FROM s WHERE k = 60"""


@query(_REWEIGHTED.format(rows=_ROWS))
def adjusted_robustly(spark, d):
    """Huber weights at 1.5 sigma; the SQL goes through the same fixed-point iteration a set number of times."""
    records, rows = _tables(spark, d, 0.0)
    design = F.array(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(1.0)))
    jobs = adjustment.fit_adjustment(records, rows.withColumn("design", design), adjustment.TRANSLATION, adjustment.Options(delta=1.5, rounds=60, tolerance=1e-11, weight_tolerance=1e-10)).jobs.where("accepted")
    return jobs.select("job_id", _r(F.get("p", F.lit(0)), 8).alias("shift_line"), _r(F.get("p", F.lit(1)), 8).alias("shift_sample"))
