"""Route preflight: footprints, overlap of convex outlines, reference selection, admissibility; adjustment diagnostics; candidates of dense flow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veldspar.functions.geometry import ground_distance
from veldspar.operators.raster import quantiles
from veldspar.tables import sized

# --- footprints --------------------------------------------------------------------------------------------------


def footprint_agreement(sampled: DataFrame, expected: DataFrame, tolerance_m: float, key: str = "footprint_id") -> DataFrame:
    """Boundaries (footprint_id, ordinal, lat, lon) compared point by point: mean_m, max_m and status: unavailable if the counts differ or there is no
    expected boundary, else agrees or disagrees."""
    a, b = (rows.select(key, "ordinal", F.col("lat").alias(f"{s}lat"), F.col("lon").alias(f"{s}lon")) for rows, s in ((sampled, "a_"), (expected, "b_")))
    both = a.join(b, [key, "ordinal"], "full")
    d = ground_distance(F.col("a_lat"), F.col("a_lon"), F.col("b_lat"), F.col("b_lon"))
    agg = both.groupBy(key).agg(F.avg(d).alias("mean_m"), F.max(d).alias("max_m"), F.bool_and(F.col("a_lat").isNotNull() & F.col("b_lat").isNotNull()).alias("paired"), F.bool_or(F.col("a_lat").isNotNull()).alias("sampled"))
    status = F.when(~F.col("paired"), "unavailable").when(F.col("max_m") <= tolerance_m, "agrees").otherwise("disagrees")
    return agg.where("sampled").select(key, F.when(F.col("paired"), F.col("mean_m")).alias("mean_m"), F.when(F.col("paired"), F.col("max_m")).alias("max_m"), status.alias("status"))


def _pairs(ring: Column) -> Column:
    """Edges of a closed ring: structs a, b of its corners (x, y)."""
    after = F.concat(F.slice(ring, 2, 1 << 30), F.slice(ring, 1, 1))
    return F.zip_with(ring, after, lambda p, q: F.struct(p.alias("a"), q.alias("b")))


def _cross(a: Column, b: Column, p: Column) -> Column:
    return (b["x"] - a["x"]) * (p["y"] - a["y"]) - (b["y"] - a["y"]) * (p["x"] - a["x"])


def signed_area(ring: Column) -> Column:
    return F.aggregate(_pairs(ring), F.lit(0.0), lambda s, e: s + e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"]) / 2


def is_convex(ring: Column) -> Column:
    after = F.concat(F.slice(ring, 3, 1 << 30), F.slice(ring, 1, 2))
    turns = F.zip_with(_pairs(ring), after, lambda e, p: _cross(e["a"], e["b"], p))
    return F.forall(turns, lambda t: t >= -1e-12) | F.forall(turns, lambda t: t <= 1e-12)


def overlap_share(first: Column, second: Column) -> Column:
    """Share of the first outline's area that the second covers; both are arrays of structs (x, y). 0 for outlines without area or not convex.

    The common region of convex outlines has for corners the corners of each that lie in the other, and the crossings of their edges; sorted around their middle they are a ring.
    Edges, areas and the middle are bound to names of an array of one, so that no loop reckons them anew."""
    once = lambda c, f: F.transform(F.array(c), f)[0]
    outline = lambda ring: F.struct(ring.alias("ring"), _pairs(ring).alias("edges"), signed_area(ring).alias("area"))
    sided = lambda o: F.struct(o["ring"].alias("ring"), o["edges"].alias("edges"), o["area"].alias("area"), F.signum(o["area"]).alias("sign"))

    def within(points: Column, o: Column) -> Column:
        return F.filter(points, lambda p: F.forall(o["edges"], lambda e: o["sign"] * _cross(e["a"], e["b"], p) >= 0))

    def crossing(e: Column, f: Column) -> Column:
        dx, dy, gx, gy = e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"], f["b"]["x"] - f["a"]["x"], f["b"]["y"] - f["a"]["y"]

        def meets(d: Column) -> Column:
            t = F.try_divide((f["a"]["x"] - e["a"]["x"]) * gy - (f["a"]["y"] - e["a"]["y"]) * gx, d)
            u = F.try_divide((f["a"]["x"] - e["a"]["x"]) * dy - (f["a"]["y"] - e["a"]["y"]) * dx, d)
            return once(t, lambda t: F.when((F.abs(d) >= 1e-15) & t.between(0, 1) & u.between(0, 1), F.struct((e["a"]["x"] + t * dx).alias("x"), (e["a"]["y"] + t * dy).alias("y"))))

        return once(dx * gy - dy * gx, meets)

    middle = lambda ps, c: F.try_divide(F.aggregate(ps, F.lit(0.0), lambda s, p: s + p[c]), F.size(ps))

    def around(ps: Column) -> Column:
        def ring(m: Column) -> Column:
            return F.transform(ps, lambda p: F.struct(F.atan2(p["y"] - m["y"], p["x"] - m["x"]).alias("t"), p["x"].alias("x"), p["y"].alias("y")))

        at = once(F.struct(middle(ps, "x").alias("x"), middle(ps, "y").alias("y")), ring)
        return once(F.sort_array(at), lambda r: F.abs(signed_area(r)))

    def share(both: Column) -> Column:
        a, b = both["a"], both["b"]
        met = F.flatten(F.transform(a["edges"], lambda e: F.filter(F.transform(b["edges"], lambda f: crossing(e, f)), lambda p: p.isNotNull())))
        common = once(F.concat(within(a["ring"], b), within(b["ring"], a), met), around)
        sound = (F.abs(a["area"]) >= 1e-12) & (F.abs(b["area"]) >= 1e-12) & is_convex(a["ring"]) & is_convex(b["ring"])
        return F.when(a["ring"] == b["ring"], 1.0).when(sound, F.coalesce(F.least(F.lit(1.0), F.try_divide(common, F.abs(a["area"]))), F.lit(0.0))).otherwise(0.0)

    return once(F.struct(once(outline(first), sided).alias("a"), once(outline(second), sided).alias("b")), share)


# --- references --------------------------------------------------------------------------------------------------


def control_of(assets: DataFrame, low: Column, high: Column) -> DataFrame:
    """Per bundle: has_control, has_control_for_span (one control asset covers the whole latitude span) and has_qualified_control (with a stated positive finite uncertainty)."""
    control = (F.col("role") == "control") & F.col("controlled")
    spans = control & (F.col("lat_low") <= low) & (low <= high) & (high <= F.col("lat_high"))
    u = F.col("horizontal_uncertainty_m")
    sure = spans & u.isNotNull() & ~F.isnan(u) & (u > 0) & (u != float("inf"))
    any_of = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    return assets.groupBy("bundle_id").agg(any_of(control).alias("has_control"), any_of(spans).alias("has_control_for_span"), any_of(sure).alias("has_qualified_control"))


#: Fixed value: latitude up to which the mid-latitude terrain model is taken.
MID_LATITUDE = 60.0
#: Cells of latitude, and those of a block.
LEAVES, LEAVES_OF_BLOCK = 1024, 32


def terrain_references(sites: DataFrame, assets: DataFrame) -> DataFrame:
    """sites: site, bundle_id, latitude. assets: bundle_id, ordinal, identifier, kind, role, lat_low, lat_high. Of the terrain assets that cover a site: the mid-latitude model up to
    60 degrees, else a polar model, else the altimeter's; the first in order of each kind. identifier and kind are null where none covers it.

    Latitudes fall into LEAVES cells, and these into blocks: for cells and blocks that assets cover whole, the first of each kind is known beforehand; only assets that end within a site's cell are met one by one."""
    a = assets.where("role = 'terrain' AND kind IN ('sldem2015', 'polar_dem', 'lola')").groupBy("bundle_id", "kind", "lat_low", "lat_high").agg(F.min("ordinal").alias("ordinal"), F.min_by("identifier", "ordinal").alias("identifier"))
    leaf = lambda c: F.floor(F.least(F.greatest((F.col(c) + 90.0) / 180.0 * LEAVES, F.lit(0.0)), F.lit(LEAVES - 1.0))).cast("long")
    upto = lambda lo, hi: F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<bigint>"))
    cells = lambda level, at: F.transform(at, lambda x: F.struct(F.lit(level).alias("level"), x.alias("cell")))
    first, last = F.ceil((F.col("_a") + 1) / LEAVES_OF_BLOCK).cast("long"), F.floor(F.col("_b") / LEAVES_OF_BLOCK).cast("long") - 1
    lone = F.when(first <= last, F.concat(upto(F.col("_a") + 1, first * LEAVES_OF_BLOCK - 1), upto((last + 1) * LEAVES_OF_BLOCK, F.col("_b") - 1))).otherwise(upto(F.col("_a") + 1, F.col("_b") - 1))
    a = a.where("lat_low is not null and lat_high is not null").withColumns({"_a": leaf("lat_low"), "_b": leaf("lat_high")})
    whole = a.select("bundle_id", "kind", "ordinal", "identifier", F.explode(F.concat(cells(0, lone), cells(1, upto(first, last)))).alias("at"))
    whole = whole.groupBy("bundle_id", "at.level", "at.cell", "kind").agg(F.min("ordinal").alias("ordinal"), F.min_by("identifier", "ordinal").alias("identifier")).withColumns({c: F.lit(None).cast("double") for c in ("lat_low", "lat_high")})
    ends = a.select("bundle_id", F.lit(0).alias("level"), F.explode(F.array_distinct(F.array("_a", "_b"))).alias("cell"), "kind", "ordinal", "identifier", *(F.col(c).cast("double").alias(c) for c in ("lat_low", "lat_high")))
    known = whole.unionByName(ends)
    looked = sites.select("site", "bundle_id", "latitude", leaf("latitude").alias("_l")).select("site", "bundle_id", "latitude", F.inline(F.array(F.struct(F.lit(0).alias("level"), F.col("_l").alias("cell")), F.struct(F.lit(1).alias("level"), F.floor(F.col("_l") / LEAVES_OF_BLOCK).cast("long").alias("cell")))))
    both = looked.join(sized(known), ["bundle_id", "level", "cell"]).where(F.col("lat_low").isNull() | F.col("latitude").between(F.col("lat_low"), F.col("lat_high")))
    rank = F.when((F.col("kind") == "sldem2015") & (F.abs("latitude") <= MID_LATITUDE), 1).when(F.col("kind") == "polar_dem", 2).when(F.col("kind") == "lola", 3)
    best = both.withColumn("_rank", rank).where("_rank IS NOT NULL").groupBy("site").agg(F.min_by(F.struct("identifier", "kind"), F.struct("_rank", "ordinal")).alias("b"))
    return sites.join(best, "site", "left").select(*sites.columns, F.col("b.identifier").alias("identifier"), F.col("b.kind").alias("kind"), F.col("b").isNotNull().alias("available"))


#: What a route needs.
LEAST_OVERLAP, MOST_GSD_RATIO, MOST_SEARCH_PX = 0.05, 8.0, 512.0
VALIDATED, UNUSABLE = "externally_validated", ("unavailable", "invalid")


def _or_null(rows: DataFrame, name: str, kind: str) -> Column:
    return F.col(name) if name in rows.columns else F.lit(None).cast(kind)


def preflight(
    routes: DataFrame, least_overlap: float = LEAST_OVERLAP, most_ratio: float = MOST_GSD_RATIO, most_search: float = MOST_SEARCH_PX,
    require_external_geometry: bool = True, require_geodetic_control: bool = True,
) -> DataFrame:
    """routes: overlap, the gsd_line_m and gsd_sample_m of source (s_) and reference (r_), s_gsd_uncertainty_m, validations (array: of the sensor, both footprints and both local geometries),
    has_control, has_qualified_control (over the source's latitudes); and, if there are such columns, sensor_limitations (array), prior_uncertainty_px (or null) and a warp prior (warp_validation, null without
    one, warp_evidence, warp_provenance, warp_uncertainty_px), which goes ahead of the other uncertainties. Adds gsd_ratio, search_radius_px, limitations, reasons (codes in order) and state:
    inadmissible with any reason, limited if a geometry isn't externally validated, else admissible. A missing control is always a limitation, and a reason where the policy demands control."""
    if not 0 < least_overlap <= 1 or most_ratio < 1 or most_search <= 0:
        raise ValueError("an overlap in (0, 1], a ratio of one at least and a positive search radius")
    opened, unusable = (F.exists("validations", f) for f in (lambda v: F.coalesce(v != VALIDATED, F.lit(True)), lambda v: F.coalesce(v.isin(*UNUSABLE), F.lit(True))))
    gsd = [F.col(f"{s}_gsd_{k}_m") for s in "sr" for k in ("line", "sample")]
    scale = F.try_divide(F.greatest(*gsd[:2]), F.least(*gsd[2:]))
    warp, evidence, provenance = (_or_null(routes, f"warp_{c}", "string") for c in ("validation", "evidence", "provenance"))
    prior = F.coalesce(_or_null(routes, "prior_uncertainty_px", "double"), 3.0 * F.try_divide(F.col("s_gsd_uncertainty_m"), F.greatest(*gsd[2:])))
    unsure = F.when(warp.isNotNull(), _or_null(routes, "warp_uncertainty_px", "double")).otherwise(prior)
    bad = F.coalesce(F.isnan(unsure) | (F.abs(unsure) == float("inf")) | (unsure < 0), F.lit(True))
    loose = warp.isNotNull() & ((warp != VALIDATED) | evidence.isNull() | (F.trim(F.coalesce(provenance, F.lit(""))) == ""))
    radius, ratio = F.greatest(F.lit(2.0), unsure * F.greatest(F.lit(1.0), scale)), F.try_divide(F.greatest(*gsd), F.least(*gsd))
    control = F.when(~F.col("has_control"), "no_geodetic_control").when(~F.col("has_qualified_control"), "control_not_qualified")
    demand = lambda on, reason: reason if on else F.lit(None).cast("string")
    reasons = F.array_compact(F.array(
        F.when(unusable, "geometry_unavailable"), demand(require_external_geometry, F.when(opened, "geometry_not_validated")), F.when(F.col("overlap") < least_overlap, "overlap_too_small"), demand(require_geodetic_control, control),
        F.when(loose, "warp_prior_not_validated"), F.when(bad, "search_uncertainty_invalid"), F.when(ratio > most_ratio, "gsd_ratio_too_large"), F.when(radius > most_search, "search_radius_too_large"),
    ))
    limits = F.array_compact(F.concat(F.coalesce(_or_null(routes, "sensor_limitations", "array<string>"), F.array().cast("array<string>")), F.array(control)))
    state = F.when(F.size("reasons") > 0, "inadmissible").when(opened, "limited").otherwise("admissible")
    return routes.withColumns({"gsd_ratio": ratio, "search_radius_px": radius, "limitations": limits, "reasons": reasons}).withColumn("state", state)


# --- adjustment diagnostics --------------------------------------------------------------------------------------


def residual_metrics(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows: dy, dx. Per group: count, rmse_y_px, rmse_x_px, rmse_2d_px, median and 90th percentile of the endpoint error."""
    y, x = F.col("dy"), F.col("dx")
    base = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(y * y)).alias("rmse_y_px"), F.sqrt(F.avg(x * x)).alias("rmse_x_px"), F.sqrt(F.avg(y * y + x * x)).alias("rmse_2d_px"))
    ends = quantiles(rows.select(*keys, F.hypot(y, x).alias("e")), keys, "e", {"median_px": 0.5, "p90_px": 0.9})
    return base.join(ends, keys, "left")


def scan_line_correlation(rows: DataFrame, keys: list[str], least_norm: float = 1e-12) -> DataFrame:
    """rows: line, dy, dx. Pearson correlation of the line with each residual; null below two rows or without variation."""
    n = F.count(F.lit(1)).cast("double")
    norm = lambda c: F.sqrt(F.var_pop(c) * n)
    agg = rows.groupBy(*keys).agg(n.alias("n"), norm("line").alias("l"), *[e.alias(a) for c in ("dy", "dx") for e, a in ((norm(c), f"n_{c}"), (F.covar_pop("line", c) * n, f"c_{c}"))])
    out = lambda c: F.when((F.col("n") >= 2) & (F.col("l") > least_norm) & (F.col(f"n_{c}") > least_norm), F.try_divide(F.col(f"c_{c}"), F.col("l") * F.col(f"n_{c}")))
    return agg.select(*keys, out("dy").alias("line_to_y"), out("dx").alias("line_to_x"))


def huber_loss(norm: Column, delta: float = 1.345) -> Column:
    """Loss of a Mahalanobis norm; rows without one don't count in a sum."""
    return F.when(norm <= delta, 0.5 * norm * norm).otherwise(delta * (norm - 0.5 * delta))


def noise_variance(rows: DataFrame, keys: list[str], template: str, warped: str) -> DataFrame:
    """Sample variance of the difference of two patches, pixel by pixel."""
    return rows.groupBy(*keys).agg(F.var_samp(F.col(template) - F.col(warped)).alias("noise_variance"))


def mahalanobis_share(rows: DataFrame, keys: list[str], scale: Column | None = None) -> DataFrame:
    """rows: dy, dx and a covariance (yy, yx, xx). Share of errors within one sigma of their covariance, times a scale if one is given: the quadratic form is compared with it."""
    det = F.col("yy") * F.col("xx") - F.col("yx") * F.col("yx")
    d2 = F.try_divide(F.col("dy") * F.col("dy") * F.col("xx") - 2 * F.col("dy") * F.col("dx") * F.col("yx") + F.col("dx") * F.col("dx") * F.col("yy"), det)
    return rows.groupBy(*keys).agg(F.avg((d2 <= (F.lit(1.0) if scale is None else scale)).cast("double")).alias("within_1sigma"))


def covariance_scale(trials: DataFrame, keys: list[str]) -> DataFrame:
    """trials: errors dy, dx of noisy repetitions and their analytic covariance (yy, yx, xx). scale: trace of the errors' covariance over the analytic trace; and the share of errors
    within one sigma before and after scaling. An error on the scaled ellipse is within it."""
    agg = trials.groupBy(*keys).agg((F.var_samp("dy") + F.var_samp("dx")).alias("_seen"), F.avg(F.col("yy") + F.col("xx")).alias("_said"), F.count(F.lit(1)).alias("n_trials"))
    scale = agg.select(*keys, "n_trials", F.try_divide("_seen", "_said").alias("scale"))
    before = mahalanobis_share(trials, keys).withColumnRenamed("within_1sigma", "coverage")
    after = mahalanobis_share(trials.join(scale, keys), keys, F.col("scale")).withColumnRenamed("within_1sigma", "calibrated_coverage")
    return scale.join(before, keys).join(after, keys)


# --- candidates of dense flow ------------------------------------------------------------------------------------


def flow_candidates(flow: DataFrame, reference_valid: DataFrame, stride: int, radius: float | None = None) -> DataFrame:
    """flow: image_id, line, sample, dy, dx, log_variance, valid, prior_dy, prior_dx. Every stride-th valid pixel whose flow stays within radius of the prior and ends on a valid pixel of
    the reference (rounded half away from zero). reference_valid: image_id, line, sample, valid."""
    rows = flow.where(F.col("valid") & (F.col("line") % stride == 0) & (F.col("sample") % stride == 0)).withColumn("ref_line", F.col("line") + F.col("dy")).withColumn("ref_sample", F.col("sample") + F.col("dx"))
    if radius is not None:
        off = (F.col("dy") - F.col("prior_dy")) * (F.col("dy") - F.col("prior_dy")) + (F.col("dx") - F.col("prior_dx")) * (F.col("dx") - F.col("prior_dx"))
        rows = rows.where(off <= radius * radius)
    rows = rows.withColumn("_l", F.round("ref_line").cast("long")).withColumn("_s", F.round("ref_sample").cast("long"))
    ok = reference_valid.where("valid").select("image_id", F.col("line").alias("_l"), F.col("sample").alias("_s"))
    inside = (F.col("ref_line") > -0.5) & (F.col("ref_sample") > -0.5)
    return rows.where(inside).join(ok, ["image_id", "_l", "_s"], "left_semi").drop("_l", "_s")


def best_candidates(rows: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """The `limit` candidates of each group with the highest score, then by line and sample."""
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), "line", "sample")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)
