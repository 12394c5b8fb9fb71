"""Raster operators over pixel tables (image_id, line, sample, value, valid): stencils are lag/lead windows, blocks are group-bys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veldspar.tables import materialise, sized


def downsample_mask(pixels: DataFrame, factor: int) -> DataFrame:
    """A block is valid if all its pixels are."""
    by = [F.floor(F.col(c) / factor).cast("int").alias(c) for c in ("line", "sample")]
    return pixels.groupBy("image_id", *by).agg(F.bool_and("valid").alias("valid"))


def with_neighbours(pixels: DataFrame) -> DataFrame:
    """Values of the four neighbours (null at edges or where invalid)."""
    v = F.when(F.col("valid"), F.col("value"))
    row, column = Window.partitionBy("image_id", "line").orderBy("sample"), Window.partitionBy("image_id", "sample").orderBy("line")
    return pixels.withColumns({"w": F.lag(v).over(row), "e": F.lead(v).over(row), "n": F.lag(v).over(column), "s": F.lead(v).over(column)})


#: The percentile of a stencil's axial differences that its gradient is divided by, and the least magnitude with an orientation.
GRADIENT_PERCENTILE, LEAST_MAGNITUDE = 95.0, 1e-12
EPS = 2.220446049250313e-16


def _scaled_cross() -> tuple[list[Column], Column]:
    """Centre, north, south, west and east divided by the greatest of their amplitudes (zeros stay), and whether the whole cross is valid."""
    cross = [F.when(F.col("valid"), F.col("value")), *[F.col(k) for k in "nswe"]]
    top = F.greatest(*map(F.abs, cross))
    whole = cross[0].isNotNull()
    for c in cross[1:]:
        whole = whole & c.isNotNull()
    return [F.coalesce(F.try_divide(c, top), F.lit(0.0)) for c in cross], whole


def _of_four(values: list[Column], percentile: float) -> Column:
    """Linear percentile of four values."""
    at = 3 * percentile / 100
    low = min(int(at), 2)
    order = F.sort_array(F.array(*values))
    return F.get(order, F.lit(low)) + (F.get(order, F.lit(low + 1)) - F.get(order, F.lit(low))) * (at - low)


def gradients(pixels: DataFrame, percentile: float = GRADIENT_PERCENTILE, least: float = LEAST_MAGNITUDE) -> DataFrame:
    """Central differences where the whole cross is valid: magnitude over the percentile of the stencil's own axial differences, at most 1;
    orientation where the magnitude (of the cross scaled by its amplitude) exceeds the least."""
    (c, n, s, w, e), whole = _scaled_cross()
    rows = with_neighbours(pixels).withColumns({"_dx": (e - w) / 2, "_dy": (s - n) / 2, "_by": _of_four([F.abs(c - x) for x in (n, s, w, e)], percentile), "_whole": whole})
    raw = F.hypot("_dx", "_dy")
    share = F.least(F.lit(1.0), F.coalesce(F.try_divide(raw, F.col("_by")), F.lit(0.0)))
    rows = rows.withColumn("magnitude", F.when(F.col("_whole"), share)).withColumn("orientation", F.when(F.col("_whole") & (raw > least), F.atan2("_dy", "_dx")))
    return rows.drop("n", "s", "w", "e", "_dx", "_dy", "_by", "_whole")


def phase_equivalent(pixels: DataFrame) -> DataFrame:
    """|4c - n - s - w - e| over the sum of absolute differences of the scaled cross, at most 1; 0 where that sum is no more than a rounding error."""
    (c, *around), whole = _scaled_cross()
    lap = F.abs(sum((c - a for a in around[1:]), c - around[0]))
    total = sum((F.abs(c - a) for a in around[1:]), F.abs(c - around[0]))
    value = F.when(whole, F.when(total > EPS, F.least(F.lit(1.0), F.try_divide(lap, total))).otherwise(0.0))
    return with_neighbours(pixels).withColumn("phase", value).drop("n", "s", "w", "e")


def square_support(pixels: DataFrame, radius: int) -> DataFrame:
    """Adds support: whether the whole square around a pixel lies in the image and is valid (dense images with lines and samples from 0)."""
    side = 2 * radius + 1
    row, column = (Window.partitionBy("image_id", k).orderBy(o).rowsBetween(-radius, radius) for k, o in (("line", "sample"), ("sample", "line")))
    ok = F.col("valid").cast("int")
    rows = pixels.withColumn("_run", F.sum(ok).over(row))
    return rows.withColumn("support", F.coalesce(F.sum((F.col("_run") == side).cast("int")).over(column) == side, F.lit(False))).drop("_run")


def self_similarity(pixels: DataFrame, patch: int = 1, search: int = 3, scale: float = 1e-6) -> DataFrame:
    """Where the whole search square is valid: the greatest exp(-mse / max(rms contrast, scale)^2) of the patch against the patches that don't overlap it.

    Each offset is a shift of the image; patch sums are sums over windows of rows, then of columns."""
    rows = square_support(pixels, patch + search)
    offsets = [(i, j) for i in range(-search, search + 1) for j in range(-search, search + 1) if max(abs(i), abs(j)) > 2 * patch]
    n = float((2 * patch + 1) ** 2)
    row, column = (Window.partitionBy("image_id", k).orderBy(o) for k, o in (("line", "sample"), ("sample", "line")))

    def box(frame: DataFrame, terms: dict[str, Column]) -> DataFrame:
        frame = frame.withColumns({f"_{k}": F.sum(v).over(row.rowsBetween(-patch, patch)) for k, v in terms.items()})
        return frame.withColumns({k: F.sum(f"_{k}").over(column.rowsBetween(-patch, patch)) for k in terms}).drop(*[f"_{k}" for k in terms])

    v = F.col("value")
    # differences to the pixel at each offset: a lead by samples within a line, of a lead by lines within a sample
    for i in sorted({i for i, _ in offsets}):
        rows = rows.withColumn(f"_up{i}", (F.lead(v, i) if i >= 0 else F.lag(v, -i)).over(column) if i else v)
    for at, (i, j) in enumerate(offsets):
        far = F.col(f"_up{i}")
        far = (F.lead(far, j) if j >= 0 else F.lag(far, -j)).over(row) if j else far
        rows = rows.withColumn(f"_d{at}", (v - far) * (v - far))
    rows = box(rows, {f"_m{at}": F.col(f"_d{at}") for at in range(len(offsets))} | {"_s": v, "_q": v * v})
    spread = F.greatest((F.col("_q") - F.col("_s") * F.col("_s") / n) / n, F.lit(scale * scale))
    scores = [F.exp(-(F.col(f"_m{at}") / n) / spread) for at in range(len(offsets))]
    rows = rows.withColumn("self_similarity", F.when(F.col("support"), F.greatest(*scores)))
    return rows.select(*pixels.columns, "self_similarity")


def structural_features(pixels: DataFrame) -> DataFrame:
    """Magnitude, orientation, phase and self-similarity of each pixel."""
    return self_similarity(phase_equivalent(gradients(pixels)))


def normalise(pixels: DataFrame) -> DataFrame:
    """Masked z-score per image with the population deviation; 0 for constant images."""
    v = F.when(F.col("valid"), F.col("value"))
    stats = pixels.groupBy("image_id").agg(F.avg(v).alias("_m"), F.stddev_pop(v).alias("_d"))
    z = F.when(F.col("valid"), F.coalesce(F.try_divide(F.col("value") - F.col("_m"), F.col("_d")), F.lit(0.0)))
    return pixels.join(stats, "image_id").withColumn("z", z).drop("_m", "_d")


def quantiles(rows: DataFrame, keys: list[str], value: str, shares: dict[str, float], bins: int = 4096) -> DataFrame:
    """Exact quantiles with linear interpolation of each group, without a group ever meeting in one task: a histogram of each group tells in which bin a
    quantile's neighbours lie, and only the distinct values of those bins are counted and ranked. Null values don't count."""
    at = Window.partitionBy(*keys)
    rows = rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    ends = rows.groupBy(*keys).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count(F.lit(1)).alias("_n"))
    bin_ = F.coalesce(F.least(F.floor(F.try_divide((F.col("_v") - F.col("_lo")) * bins, F.col("_hi") - F.col("_lo"))), F.lit(bins - 1)), F.lit(0)).cast("int")
    binned = rows.join(ends.drop("_n"), keys).withColumn("_bin", bin_)
    hist = binned.groupBy(*keys, "_bin").agg(F.count(F.lit(1)).alias("_c")).withColumn("_to", F.sum("_c").over(at.orderBy("_bin")))
    places = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(float(p)).alias("p")) for n, p in shares.items()])
    h = (F.col("_n") - 1) * F.col("_p.p")
    wanted = ends.select(*keys, "_n", F.explode(places).alias("_p")).withColumn("_h", h)
    wanted = wanted.select(*keys, F.col("_p.name").alias("_name"), (F.col("_h") - F.floor("_h")).alias("_part"), F.explode(F.array(F.floor("_h"), F.ceil("_h"))).alias("_rank"))
    held = wanted.join(hist, keys).where((F.col("_rank") >= F.col("_to") - F.col("_c")) & (F.col("_rank") < F.col("_to")))
    held = held.select(*keys, "_name", "_part", "_rank", "_bin", (F.col("_to") - F.col("_c")).alias("_before")).distinct()
    near = binned.join(held.select(*keys, "_bin", "_before").distinct(), [*keys, "_bin"]).groupBy(*keys, "_bin", "_before", "_v").agg(F.count(F.lit(1)).alias("_c"))
    near = near.withColumn("_to", F.col("_before") + F.sum("_c").over(Window.partitionBy(*keys, "_bin").orderBy("_v"))).drop("_before")
    found = held.join(near, [*keys, "_bin"]).where((F.col("_rank") >= F.col("_to") - F.col("_c")) & (F.col("_rank") < F.col("_to")))
    each = found.groupBy(*keys, "_name").agg((F.min("_v") + (F.max("_v") - F.min("_v")) * F.first("_part")).alias("_q"))
    return each.groupBy(*keys).agg(*[F.max(F.when(F.col("_name") == n, F.col("_q"))).alias(n) for n in shares])


def preview(pixels: DataFrame, low: float = 0.02, high: float = 0.98) -> DataFrame:
    """Stretch between percentiles of the valid pixels to 0..255, truncated; invalid pixels are 0."""
    stats = quantiles(pixels.where("valid"), ["image_id"], "value", {"_l": low, "_h": high})
    t = F.try_divide(F.col("value") - F.col("_l"), F.col("_h") - F.col("_l"))
    out = F.when(F.col("valid"), F.floor(F.least(F.greatest(F.coalesce(t, F.lit(0.0)), F.lit(0.0)), F.lit(1.0)) * 255.0)).otherwise(0).cast("int")
    return pixels.join(stats, "image_id", "left").withColumn("byte", out).drop("_l", "_h")


def shadow_statistics(pixels: DataFrame) -> DataFrame:
    return quantiles(pixels.where("valid"), ["image_id"], "value", {"p5": 0.05, "p20": 0.2, "p95": 0.95, "median": 0.5})


#: Percentiles of dark and half-dark pixels, deviations and gap that part a dark tail, and the least number of valid pixels.
DARK, PENUMBRA, MAD_TIMES, TAIL_GAP, LEAST_VALID = 0.05, 0.2, 3.5, 0.5, 32
TINY = 2.2250738585072014e-308


def lower_tail(value: Column, threshold: Column, least: Column) -> Column:
    """Whether a value is in the low tail: all of the least values if the quantile is the least itself, else what lies strictly below the quantile."""
    return F.when(threshold == least, value == least).otherwise(value < threshold)


def shadow_decisions(pixels: DataFrame, dark: float = DARK, penumbra: float = PENUMBRA, mad_times: float = MAD_TIMES, tail_gap: float = TAIL_GAP, least_valid: int = LEAST_VALID) -> DataFrame:
    """Per image: amplitude, thresholds on values divided by it, status, robust_tail and discrete_tail (null where not asked).

    A dark tail counts only if it lies many deviations below the median, or a wide gap parts it from the rest."""
    valid = pixels.where("valid").select("image_id", "value")
    top = valid.groupBy("image_id").agg(F.max(F.abs("value")).alias("amplitude"), F.count(F.lit(1)).alias("n_valid"))
    scaled = valid.join(top, "image_id").select("image_id", F.coalesce(F.try_divide(F.col("value"), F.col("amplitude")), F.col("value")).alias("v"))
    stats = quantiles(scaled, ["image_id"], "v", {"shadow": dark, "penumbra": penumbra, "median": 0.5, "high": 0.95})
    off = scaled.join(stats.select("image_id", "median"), "image_id").select("image_id", F.abs(F.col("v") - F.col("median")).alias("off"))
    mad = quantiles(off, ["image_id"], "off", {"mad": 0.5})
    least = scaled.groupBy("image_id").agg(F.min("v").alias("least"))
    stats = stats.join(mad, "image_id").join(least, "image_id")
    chosen = scaled.join(stats, "image_id").withColumn("in_tail", lower_tail(F.col("v"), F.col("shadow"), F.col("least")))
    edges = chosen.groupBy("image_id").agg(F.max(F.when(F.col("in_tail"), F.col("v"))).alias("last_dark"), F.min(F.when(~F.col("in_tail"), F.col("v"))).alias("next"))
    images = pixels.select("image_id").distinct().join(top, "image_id", "left").join(stats, "image_id", "left").join(edges, "image_id", "left")
    zero = F.lit(0.0)
    gap, below, span = (F.coalesce(x, zero) for x in (F.col("next") - F.col("last_dark"), F.col("median") - F.col("last_dark"), F.col("high") - F.col("last_dark")))
    few, flat = F.coalesce(F.col("n_valid"), F.lit(0)) < least_valid, span <= TINY
    robust = (F.col("mad") > TINY) & (below > 0) & (F.coalesce(F.try_divide(below, F.col("mad")), zero) >= mad_times)
    discrete = (gap > 0) & (F.coalesce(F.try_divide(gap, span), zero) >= tail_gap)
    asked = ~few & ~flat
    status = F.when(few, "no_confident_shadow:insufficient_valid_samples").when(flat, "no_confident_shadow:constant_or_insufficient_distribution").when(robust | discrete, "ok").otherwise("no_confident_shadow:no_separated_dark_tail")
    return images.select("image_id", "amplitude", *[F.when(~few, F.col(c)).alias(c) for c in ("shadow", "penumbra", "median", "mad", "least")], status.alias("status"), F.when(asked, robust).alias("robust_tail"), F.when(asked, discrete).alias("discrete_tail"))


def shadows(pixels: DataFrame, **how) -> DataFrame:
    """Adds shadow, penumbra (valid pixels of the half-dark band that aren't shadow) and confidence: 1 in shadow, 0.25 to 0.75 in the penumbra by depth, 0 elsewhere."""
    rows = pixels.join(shadow_decisions(pixels, **how), "image_id")
    v = F.coalesce(F.try_divide(F.col("value"), F.col("amplitude")), F.col("value"))
    wide = F.col("robust_tail").isNotNull() & (F.col("penumbra_at") > F.col("shadow_at"))
    dark = F.coalesce(F.col("valid") & (F.col("status") == "ok") & lower_tail(v, F.col("shadow_at"), F.col("least")), F.lit(False))
    half = F.coalesce(F.col("valid") & wide & lower_tail(v, F.col("penumbra_at"), F.col("least")), F.lit(False)) & ~dark
    depth = 0.25 + 0.5 * F.try_divide(F.col("penumbra_at") - v, F.col("penumbra_at") - F.col("shadow_at"))
    sure = F.when(dark, 1.0).when(half, F.least(F.lit(0.75), F.greatest(F.lit(0.25), depth))).otherwise(0.0)
    rows = rows.withColumnRenamed("shadow", "shadow_at").withColumnRenamed("penumbra", "penumbra_at")
    return rows.select(*pixels.columns, dark.alias("shadow"), half.alias("penumbra"), sure.alias("confidence"))


# --- channels of the learned matcher -----------------------------------------------------------------------------


def z_score(pixels: DataFrame, value: str, ok: Column, name: str) -> DataFrame:
    """Adds a column of masked z-scores per image; 0 where not ok, and for images without spread. A row an image goes to the pixels, which stay where they are."""
    v = F.when(ok, F.col(value))
    stats = materialise(pixels.groupBy("image_id").agg(F.avg(v).alias("_m"), F.stddev_pop(v).alias("_d")))
    z = F.when(ok & (F.col("_d") > EPS), F.try_divide(F.col(value) - F.col("_m"), F.col("_d"))).otherwise(0.0)
    return pixels.join(sized(stats), "image_id", "left").withColumn(name, F.coalesce(z, F.lit(0.0))).drop("_m", "_d")


def derivative(pixels: DataFrame, value: str, axis: str, name: str) -> DataFrame:
    """Adds name (one-sided at the image's edges, central inside; 0 without support) and name_ok (the whole stencil is valid)."""
    w = Window.partitionBy("image_id", "sample" if axis == "line" else "line").orderBy(axis)
    before, after, ok = F.lag(value).over(w), F.lead(value).over(w), F.col("valid")
    ok_before, ok_after = F.lag("valid").over(w), F.lead("valid").over(w)
    rows = pixels.withColumns({"_b": before, "_a": after, "_ob": ok_before, "_oa": ok_after})
    v = F.col(value)
    support = F.when(F.col("_ob").isNull(), ok & F.col("_oa")).when(F.col("_oa").isNull(), ok & F.col("_ob")).otherwise(ok & F.col("_ob") & F.col("_oa"))
    slope = F.when(F.col("_ob").isNull(), F.col("_a") - v).when(F.col("_oa").isNull(), v - F.col("_b")).otherwise((F.col("_a") - F.col("_b")) * 0.5)
    rows = rows.withColumn(f"{name}_ok", F.coalesce(support, F.lit(False)))
    return rows.withColumn(name, F.when(F.col(f"{name}_ok"), slope).otherwise(0.0)).drop("_b", "_a", "_ob", "_oa")


def box_mean(pixels: DataFrame, value: str, name: str, radius: int = 1) -> DataFrame:
    """Adds the mean of the valid pixels of the square around each pixel (0 without any): sums by line, then by sample."""
    row, column = (Window.partitionBy("image_id", k).orderBy(o).rowsBetween(-radius, radius) for k, o in (("line", "sample"), ("sample", "line")))
    rows = pixels.withColumns({"_s": F.sum(F.when(F.col("valid"), F.col(value)).otherwise(0.0)).over(row), "_c": F.sum(F.col("valid").cast("int")).over(row)})
    rows = rows.withColumns({"_s2": F.sum("_s").over(column), "_c2": F.sum("_c").over(column)})
    return rows.withColumn(name, F.coalesce(F.try_divide(F.col("_s2"), F.col("_c2").cast("double")), F.lit(0.0))).drop("_s", "_c", "_s2", "_c2")


def learned_channels(pixels: DataFrame) -> DataFrame:
    """The fixed channels in order: normalised, d_line, d_sample, magnitude, contrast; 0 where a pixel isn't valid. What a score is taken of is a table, so that
    no step is made twice and a task sorts a few columns of pixels."""
    rows = z_score(materialise(pixels), "value", F.col("valid"), "normalised")
    for axis in ("line", "sample"):
        rows = materialise(derivative(rows, "normalised", axis, f"_{axis}"))
        rows = z_score(rows, f"_{axis}", F.col(f"_{axis}_ok"), f"d_{axis}")
    rows = rows.withColumn("_mag", F.hypot("d_line", "d_sample"))
    rows = z_score(rows, "_mag", F.col("_line_ok") & F.col("_sample_ok"), "magnitude")
    rows = materialise(box_mean(rows, "normalised", "_mean").withColumn("_off", F.col("normalised") - F.col("_mean")))
    rows = z_score(rows, "_off", F.col("valid"), "contrast")
    names = ["normalised", "d_line", "d_sample", "magnitude", "contrast"]
    return rows.select(*pixels.columns, *[F.when(F.col("valid"), F.col(c)).otherwise(0.0).alias(c) for c in names])


def ncc(pairs: DataFrame, keys: list[str], x: Column, y: Column) -> DataFrame:
    """Masked zero-mean normalised cross-correlation of x and y per group; null without variance, or unless more than half of the pairs are valid (not null)."""
    both = x.isNotNull() & y.isNotNull()
    rows = pairs.select(*keys, F.when(both, x).alias("x"), F.when(both, y).alias("y"))
    s = rows.groupBy(*keys).agg(F.count("x").cast("double").alias("n"), F.count(F.lit(1)).alias("all"), F.sum("x").alias("sx"), F.sum("y").alias("sy"), F.sum(F.col("x") * F.col("y")).alias("sxy"), F.sum(F.col("x") * F.col("x")).alias("sxx"), F.sum(F.col("y") * F.col("y")).alias("syy"))
    vx, vy = F.col("sxx") - F.col("sx") * F.col("sx") / F.col("n"), F.col("syy") - F.col("sy") * F.col("sy") / F.col("n")
    cov = F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")
    return s.select(*keys, F.when((F.col("n") > 0.5 * F.col("all")) & (vx > 1e-12) & (vy > 1e-12), cov / F.sqrt(vx * vy)).alias("ncc"))
