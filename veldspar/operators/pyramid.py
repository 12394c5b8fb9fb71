"""Pyramid operators over dense pixel tables (image_id, line, sample from 0, value, valid): blur, decimation, resampling, masks, local radiometry."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from veldspar.tables import materialise, sized

_ALL = (Window.unboundedPreceding, Window.unboundedFollowing)


def _axes() -> tuple[WindowSpec, WindowSpec]:
    """Along a line, and along a sample."""
    return Window.partitionBy("image_id", "line").orderBy("sample"), Window.partitionBy("image_id", "sample").orderBy("line")


def kernel(sigma: float) -> list[float]:
    """Gaussian weights from the centre to three sigmas, normalised over both sides."""
    half = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(math.ceil(3 * sigma) + 1)]
    total = half[0] + 2 * sum(half[1:])
    return [x / total for x in half]


def gaussian_blur(pixels: DataFrame, sigma: float) -> DataFrame:
    """Separable blur with replicated edges: a weighted sum of lags and leads by line, then by sample (one shuffle each)."""
    if not sigma > 0:
        raise ValueError("sigma must be positive")

    def along(w) -> Column:
        v, first, last = F.col("value"), F.first("value").over(w.rowsBetween(*_ALL)), F.last("value").over(w.rowsBetween(*_ALL))
        sides = [x * (F.coalesce(F.lag(v, k).over(w), first) + F.coalesce(F.lead(v, k).over(w), last)) for k, x in enumerate(kernel(sigma)) if k]
        return reduce(lambda a, b: a + b, sides, v * kernel(sigma)[0])

    return pixels.withColumn("value", along(_axes()[0])).withColumn("value", along(_axes()[1]))


def decimate(pixels: DataFrame, ratio: float, sigma: float | None = None) -> DataFrame:
    """Blur against aliasing, then every floor(ratio)-th pixel; a block is valid if all its pixels are. A ratio under 2 changes nothing."""
    d = math.floor(ratio)
    if d < 2:
        return pixels
    block = Window.partitionBy("image_id", F.floor(F.col("line") / d), F.floor(F.col("sample") / d))
    rows = gaussian_blur(pixels, sigma or 0.5 * math.sqrt(d * d - 1)).withColumn("valid", F.bool_and("valid").over(block))
    rows = rows.where((F.col("line") % d == 0) & (F.col("sample") % d == 0))
    return rows.withColumns({c: F.floor(F.col(c) / d).cast("long") for c in ("line", "sample")})


def pyramid_levels(pairs: DataFrame, levels: int) -> DataFrame:
    """pairs: columns gsd_m and reference_gsd_m among others. Adds a row per level: level, level_gsd_m = the coarser of both times 2^level."""
    rows = pairs.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))))
    return rows.withColumn("level_gsd_m", F.greatest("gsd_m", "reference_gsd_m") * F.pow(F.lit(2.0), "level"))


def _at(c: str, n_in: Column, n_out: int) -> Column:
    """Both source pixels of an output pixel and their weights, centre-aligned and clamped."""
    x = F.least(F.greatest((F.col(c) + 0.5) * n_in / n_out - 0.5, F.lit(0.0)), (n_in - 1).cast("double"))
    low = F.floor(x)
    return F.array(F.struct(low.alias("i"), (1 - (x - low)).alias("w")), F.struct(F.least(low + 1, n_in - 1).alias("i"), (x - low).alias("w")))


def resize_bilinear(pixels: DataFrame, lines: int, samples: int) -> DataFrame:
    """image_id, line, sample, value on a lines x samples grid: four weighted neighbours each, joined by position."""
    size = pixels.groupBy("image_id").agg((F.max("line") + 1).alias("h"), (F.max("sample") + 1).alias("w"))
    grid = size.withColumn("line", F.explode(F.sequence(F.lit(0), F.lit(lines - 1)))).withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
    grid = grid.withColumn("_l", F.explode(_at("line", F.col("h"), lines))).withColumn("_s", F.explode(_at("sample", F.col("w"), samples)))
    near = grid.select("image_id", F.col("line").alias("to_line"), F.col("sample").alias("to_sample"), F.col("_l.i").alias("line"), F.col("_s.i").alias("sample"), (F.col("_l.w") * F.col("_s.w")).alias("weight"))
    near = near.where("weight > 0").join(pixels.select("image_id", "line", "sample", "value"), ["image_id", "line", "sample"])
    return near.groupBy("image_id", F.col("to_line").alias("line"), F.col("to_sample").alias("sample")).agg(F.sum(F.col("weight") * F.col("value")).alias("value"))


def resample_mask(pixels: DataFrame, lines: int, samples: int) -> DataFrame:
    """An output pixel is valid if every pixel that its window touches is: each pixel goes to the outputs it touches."""
    size = pixels.groupBy("image_id").agg((F.max("line") + 1).alias("h"), (F.max("sample") + 1).alias("w"))
    span = lambda c, n_in, n_out: F.explode(F.sequence(F.floor(F.col(c) * n_out / F.col(n_in)), F.ceil((F.col(c) + 1) * n_out / F.col(n_in)) - 1))
    rows = pixels.select("image_id", "line", "sample", "valid").join(size, "image_id")
    rows = rows.withColumn("to_line", span("line", "h", lines)).withColumn("to_sample", span("sample", "w", samples))
    return rows.groupBy("image_id", F.col("to_line").alias("line"), F.col("to_sample").alias("sample")).agg(F.bool_and("valid").alias("valid"))


def resampled(pixels: DataFrame, ratio: float, sigma: float | None = None) -> DataFrame:
    """Images on a grid whose pixels are `ratio` times as large (1 at least), edges aligned: blurred (by the instrument's sigma, else 0.5 sqrt(ratio^2 - 1)), then sampled between the centres; an output pixel is valid if all
    that it covers is. Raises if an image's extent isn't a whole number of such pixels."""
    if ratio < 1:
        raise ValueError("a common grid is not finer than the image's own")
    if ratio == 1:
        return pixels.select("image_id", "line", "sample", "value", "valid")
    size = materialise(pixels.groupBy("image_id").agg((F.max("line") + 1).alias("h"), (F.max("sample") + 1).alias("w")))
    odd = lambda c: F.abs(F.col(c) / ratio - F.round(F.col(c) / ratio)) > 1e-9
    bad = size.where(odd("h") | odd("w")).first()
    if bad:
        raise ValueError(f"image {bad['image_id']!r}: {bad['h']} x {bad['w']} pixels are no whole number of pixels {ratio} times as large")
    soft = gaussian_blur(pixels, sigma or 0.5 * math.sqrt(ratio * ratio - 1))

    def targets(c: str, n: str) -> Column:
        """The output pixels that a pixel weighs in, and its weight: those whose centre lies within a pixel of it, clamped at the edges."""
        centre = lambda o: F.least(F.greatest((o + 0.5) * ratio - 0.5, F.lit(0.0)), (F.col(n) - 1).cast("double"))
        top = F.round(F.col(n) / ratio).cast("long") - 1
        low, high = F.greatest(F.floor((F.col(c) - 0.5) / ratio - 0.5), F.lit(0)).cast("long"), F.least(F.ceil((F.col(c) + 1.5) / ratio - 0.5), top).cast("long")
        near = F.transform(F.sequence(F.least(low, top), F.greatest(high, F.lit(0))), lambda o: F.struct(o.alias("to"), (1 - F.abs(F.col(c) - centre(o))).alias("weight")))
        return F.explode(F.filter(near, lambda s: s["weight"] > 0))

    rows = soft.join(sized(size), "image_id").withColumn("_l", targets("line", "h")).withColumn("_s", targets("sample", "w"))
    values = rows.groupBy("image_id", F.col("_l.to").alias("line"), F.col("_s.to").alias("sample")).agg(F.sum(F.col("value") * F.col("_l.weight") * F.col("_s.weight")).alias("value"))
    cover = lambda c: F.explode(F.sequence(F.floor(F.col(c) / ratio), F.ceil((F.col(c) + 1) / ratio) - 1))
    masks = pixels.select("image_id", "line", "sample", "valid").withColumn("_l", cover("line")).withColumn("_s", cover("sample"))
    masks = masks.groupBy("image_id", F.col("_l").alias("line"), F.col("_s").alias("sample")).agg(F.bool_and(F.coalesce("valid", F.lit(False))).alias("valid"))
    return values.join(masks, ["image_id", "line", "sample"])


def paired_pyramid(source: DataFrame, reference: DataFrame, source_gsd: float, reference_gsd: float, levels: int = 1, source_sigma: float | None = None, reference_sigma: float | None = None) -> tuple[DataFrame, list[dict]]:
    """Both sides of image pairs at common ground sampling distances: the coarser of both, doubled at each level. Gives the pixels (level, side, image_id, line, sample, value, valid), and for each level and side its gsd_m, ratio, method,
    provenance of the blur and the place of its first centre (origin_m)."""
    if levels < 1 or source_gsd <= 0 or reference_gsd <= 0:
        raise ValueError("one level at least and positive distances")
    out, facts = [], []
    for level in range(levels):
        target = max(source_gsd, reference_gsd) * 2**level
        for side, pixels, gsd, sigma in (("source", source, source_gsd, source_sigma), ("reference", reference, reference_gsd, reference_sigma)):
            ratio = target / gsd
            out.append(resampled(pixels, ratio, sigma).select(F.lit(level).alias("level"), F.lit(side).alias("side"), "image_id", "line", "sample", "value", "valid"))
            blurred = ratio > 1
            facts.append({"level": level, "side": side, "gsd_m": target, "ratio": ratio, "method": "gaussian_blur_before_resample" if blurred else "none", "provenance": ("instrument_psf" if sigma else "gaussian_fallback") if blurred else "none", "origin_m": (target - gsd) / 2})
    return reduce(DataFrame.unionByName, out), facts


def combine_masks(*masks: DataFrame) -> DataFrame:
    """image_id, line, sample, eligible: valid in every mask; a pixel that a mask lacks is not eligible. One shuffle for any number of masks."""
    rows = reduce(DataFrame.unionByName, [m.select("image_id", "line", "sample", "valid") for m in masks])
    return rows.groupBy("image_id", "line", "sample").agg((F.bool_and(F.coalesce("valid", F.lit(False))) & (F.count(F.lit(1)) == len(masks))).alias("eligible"))


def _median(values: Column) -> Column:
    s = F.sort_array(values)
    return F.transform(F.array(s), lambda x: (F.get(x, F.floor((F.size(x) - 1) / 2).cast("int")) + F.get(x, F.floor(F.size(x) / 2).cast("int"))) / 2)[0]


def local_radiometry(pixels: DataFrame, window: int = 15, least_fraction: float = 0.5, least_count: int = 9, clip: float = 3.0) -> DataFrame:
    """Adds radiometry: (value - local median) / (1.4826 MAD), over clip, cut to [-1, 1]; 0 where the MAD vanishes; null where invalid or
    where too few pixels of the window (cut off at the edges) are valid. Lists hold window x window values at most."""
    r = window // 2
    across, down = (w.rowsBetween(-r, r) for w in _axes())
    v = F.when(F.col("valid"), F.col("value"))
    rows = pixels.withColumns({"_a": F.collect_list(v).over(across), "_n": F.count(F.lit(1)).over(across)})
    rows = rows.withColumns({"_b": F.flatten(F.collect_list("_a").over(down)), "_n": F.sum("_n").over(down)})
    rows = rows.withColumn("_m", _median(F.col("_b")))
    rows = rows.withColumn("_d", 1.4826 * _median(F.transform("_b", lambda x: F.abs(x - F.col("_m")))))
    ok = F.col("valid") & (F.size("_b") >= F.greatest(F.lit(least_count), F.ceil(F.col("_n") * least_fraction)))
    z = F.when(F.col("_d") <= 1e-12, 0.0).otherwise((F.col("value") - F.col("_m")) / F.col("_d") / clip)
    return rows.withColumn("radiometry", F.when(ok, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), z)))).drop("_a", "_b", "_n", "_m", "_d")
