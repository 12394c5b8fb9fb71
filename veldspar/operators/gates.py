"""Quality gates, scene verdicts and scene metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veldspar.operators.raster import quantiles
from veldspar.tables import sized


def compare(comparison: Column, value: Column, threshold: Column) -> Column:
    return F.when(comparison == "lt", value < threshold).when(comparison == "le", value <= threshold).when(comparison == "gt", value > threshold).when(comparison == "ge", value >= threshold)


def evaluate_gates(evidence: DataFrame, gates: DataFrame) -> DataFrame:
    """A row per scene and gate. Not applicable: passed is null; a metric missing from an applicable gate: passed is false."""
    rows = evidence.join(sized(gates))  # a handful of rules
    value = F.try_element_at("metrics", F.col("metric_name"))
    na = (
        F.when(F.col("route_qualification_only") & ~F.col("route_qualified"), "route_not_qualified")
        .when(F.col("requires_independent_control") & ~F.col("has_independent_control"), "no_independent_control")
        .when(F.col("requires_absolute_control_uncertainty") & F.col("control_uncertainty_m").isNull(), "no_control_uncertainty")
    )
    passed = F.when(na.isNotNull(), None).when(value.isNull(), False).otherwise(compare(F.col("comparison"), value, F.col("threshold")))
    return rows.select("scene", "ord", "name", "kind", "route_qualified", na.alias("not_applicable"), value.alias("value"), passed.alias("passed"))


def scene_verdicts(results: DataFrame) -> DataFrame:
    """Unqualified: reject; a failed hard gate: reject; a failed soft gate: review; else accept. Reasons list all failures in order."""
    failed = lambda kind: F.bool_or((F.col("kind") == kind) & ~F.coalesce("passed", F.lit(True)))
    reasons = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(~F.col("passed"), F.struct("ord", "name")))), lambda x: x["name"]), ";")
    agg = results.groupBy("scene").agg(F.bool_and("route_qualified").alias("q"), failed("hard").alias("h"), failed("soft").alias("s"), reasons.alias("reason"))
    verdict = F.when(~F.col("q"), "reject").when(F.col("h"), "reject").when(F.col("s"), "review").otherwise("accept")
    return agg.select("scene", verdict.alias("verdict"), "reason")


def scene_metrics(points: DataFrame, key: str = "job_id") -> DataFrame:
    """Inlier ratio, RMSE, median and P90 of residuals; empty denominators give null."""
    e = F.when(F.col("is_inlier"), F.col("residual_px"))
    counts = points.groupBy(key).agg(
        F.count(F.lit(1)).alias("candidates"),
        F.count_if("is_inlier").alias("inliers"),
        F.try_divide(F.count_if("is_inlier").cast("double"), F.count(F.lit(1)).cast("double")).alias("inlier_ratio"),
        F.sqrt(F.avg(e * e)).alias("rmse_px"),
    )
    return counts.join(quantiles(points.select(key, e.alias("e")), [key], "e", {"median_px": 0.5, "p90_px": 0.9}), key, "left")


def scene_evidence(points: DataFrame, coverage: DataFrame, cells: int, key: str = "job_id") -> DataFrame:
    """The metrics that gates read. points: is_candidate, is_inlier, point_role, estimator_disagreement_px, has_covariance, covariance_calibrated, residual_px.
    coverage: occupancy, largest_empty_run (over all cells of the grid). A metric without anything to count is null, never 0."""
    inlier, share = F.col("is_inlier"), lambda part, whole: F.try_divide(F.count_if(part).cast("double"), F.count_if(whole).cast("double"))
    withheld = F.when(F.col("point_role") == "withheld_check_point", F.col("residual_px"))
    found = points.groupBy(key).agg(
        share(inlier & F.col("is_candidate"), F.col("is_candidate")).alias("verified_inlier_fraction"),
        F.max("estimator_disagreement_px").alias("max_estimator_disagreement_px"),
        share(inlier & ~F.col("has_covariance"), inlier).alias("invalid_covariance_fraction"),
        share(inlier & F.col("has_covariance") & ~F.col("covariance_calibrated"), inlier).alias("uncalibrated_covariance_fraction"),
        F.sqrt(F.avg(withheld * withheld)).alias("withheld_rmse_2d_px"),
    )
    grid = coverage.select(key, F.col("occupancy").alias("eligible_occupancy"), F.try_divide(F.col("largest_empty_run").cast("double"), F.lit(float(cells))).alias("largest_empty_run_fraction"))
    return found.join(grid, key, "left")


def refinement_counts(points: DataFrame, key: str = "job_id") -> DataFrame:
    """attempted, refined, with covariance, calibrated and failed of the selected points."""
    chosen, done = F.col("selected"), F.col("selected") & F.col("refined")
    return points.groupBy(key).agg(
        F.count_if(chosen).alias("attempted"), F.count_if(done).alias("refined"), F.count_if(done & F.col("has_covariance")).alias("covariances"),
        F.count_if(done & F.col("has_covariance") & F.col("covariance_calibrated")).alias("calibrated"), F.count_if(chosen & ~F.col("refined")).alias("failed"),
    )
