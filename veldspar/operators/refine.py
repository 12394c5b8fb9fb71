"""Patches around points of an image (image_id, line, sample from 0, value, valid): extraction, texture, sub-pixel sampling; spectral bands of labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veldspar.tables import materialise, sized


#: Lines and samples of the blocks that windows are cut from.
BLOCK = 32
_PLACE = ["image_id", "_l", "_s"]


def _placed(points: DataFrame) -> DataFrame:
    return points.select("point_id", "image_id", F.bround("line").cast("long").alias("_l"), F.bround("sample").cast("long").alias("_s"))


def _blocks(pixels: DataFrame, half: int) -> DataFrame:
    """A row per block of an image (image_id, _bl, _bs): its pixels and those up to half around it as cells (value, valid) of the rectangle _l0.._l1, _s0.._s1 by line, then sample; null where there is no pixel."""
    reach = lambda c: F.explode(F.sequence(F.floor((F.col(c) - half) / F.lit(float(BLOCK))).cast("long"), F.floor((F.col(c) + half) / F.lit(float(BLOCK))).cast("long")))
    rows = pixels.select("image_id", F.col("line").cast("long").alias("line"), F.col("sample").cast("long").alias("sample"), "value", "valid")
    rows = rows.select("*", reach("line").alias("_bl")).select("*", reach("sample").alias("_bs"))
    held = rows.groupBy("image_id", "_bl", "_bs").agg(*[f(c).alias(n) for n, f, c in (("_l0", F.min, "line"), ("_l1", F.max, "line"), ("_s0", F.min, "sample"), ("_s1", F.max, "sample"))], F.sort_array(F.collect_list(F.struct("line", "sample", "value", "valid"))).alias("_c"))
    width = F.col("_s1") - F.col("_s0") + 1
    area = (F.col("_l1") - F.col("_l0") + 1) * width
    at = F.transform("_c", lambda c: (c["line"] - F.col("_l0")) * width + c["sample"] - F.col("_s0"))
    cells = F.transform("_c", lambda c: F.struct(c["value"].alias("value"), c["valid"].alias("valid")))
    held = held.withColumns({"_at": at, "_c": cells})
    holes = F.transform(F.sequence(F.lit(0).cast("long"), area - 1), lambda i: F.get("_c", (F.array_position("_at", i) - 1).cast("int")))
    return held.withColumn("cells", F.when(F.size("_c") == area, F.col("_c")).otherwise(holes)).drop("_at", "_c")


def _seen(placed: DataFrame, pixels: DataFrame, half: int, least_valid: float) -> DataFrame:
    """Each distinct place of points (image_id, _l, _s) once, however many points it has: status, valid_fraction, and cells, the (2 half + 1)^2 cells (value, valid) around it by line, then sample (null
    unless ok). A place meets the one block that holds its window, a row on each side."""
    block = lambda c: F.floor(F.col(c) / F.lit(float(BLOCK))).cast("long")
    places = placed.select(*_PLACE).distinct().withColumns({"_bl": block("_l"), "_bs": block("_s")})
    met = places.join(_blocks(pixels, half).hint("merge"), ["image_id", "_bl", "_bs"], "left")
    inside = (F.col("_l") - half >= F.col("_l0")) & (F.col("_l") + half <= F.col("_l1")) & (F.col("_s") - half >= F.col("_s0")) & (F.col("_s") + half <= F.col("_s1"))
    start = lambda dy: ((F.col("_l") + dy - F.col("_l0")) * (F.col("_s1") - F.col("_s0") + 1) + F.col("_s") - half - F.col("_s0") + 1).cast("int")
    side = 2 * half + 1
    cut = F.when(inside, F.concat(*[F.slice("cells", F.when(inside, start(dy)).otherwise(1), side) for dy in range(-half, half + 1)]))
    met = met.select(*_PLACE, cut.alias("cells"))
    whole = F.coalesce(F.forall("cells", lambda c: c.isNotNull()), F.lit(False))
    share = F.size(F.filter("cells", lambda c: c["valid"])) / F.lit(float(side * side))
    status = F.when(~whole, "out_of_bounds").when(share < least_valid, "too_few_valid").otherwise("ok")
    return met.select(*_PLACE, status.alias("status"), F.when(whole, share).alias("valid_fraction"), F.when(status == "ok", F.col("cells")).alias("cells"))


def _of_places(placed: DataFrame, seen: DataFrame, how: str) -> DataFrame:
    return placed.join(sized(materialise(seen)), _PLACE, how).drop(*_PLACE)


def patches(points: DataFrame, pixels: DataFrame, half: int, least_valid: float, with_cells: bool = True) -> DataFrame:
    """points: point_id, image_id, line, sample (fractional; the centre is rounded half to even). pixels: one row a pixel. Gives a row per point with status (ok, out_of_bounds, too_few_valid),
    valid_fraction and, if asked, cells: the (value, valid) of the window by line, then sample, of the points that are ok."""
    placed = _placed(points)
    seen = _seen(placed, pixels, half, least_valid)
    rows = _of_places(placed, seen if with_cells else seen.drop("cells"), "left")
    return rows.withColumn("status", F.coalesce("status", F.lit("out_of_bounds")))  # a point without a place


def texture(cells: Column, half: int) -> Column:
    """Mean squared gradient of a patch's cells: central differences, one-sided at its edges."""
    side = 2 * half + 1

    def slope(i: Column, along: Column, step: int) -> Column:
        value = lambda k: F.get(cells, k)["value"]
        before, after = F.when(along > 0, value(i - step)), F.when(along < side - 1, value(i + step))
        return F.when(before.isNull(), after - value(i)).when(after.isNull(), value(i) - before).otherwise((after - before) / 2)

    def squared(i: Column) -> Column:
        y, x = slope(i, F.floor(i / F.lit(side)), side), slope(i, i % side, 1)
        return y * y + x * x

    found = F.filter(F.transform(F.sequence(F.lit(0), F.lit(side * side - 1)), squared), lambda v: v.isNotNull())
    return F.try_divide(F.aggregate(found, F.lit(0.0), lambda s, v: s + v), F.size(found))


def textures(points: DataFrame, pixels: DataFrame, half: int, least_valid: float) -> DataFrame:
    """point_id, texture of the points (as of patches) whose patch is ok; reckoned once a place."""
    placed = _placed(points)
    seen = _seen(placed, pixels, half, least_valid).where("status = 'ok'").select(*_PLACE, texture(F.col("cells"), half).alias("texture"))
    return _of_places(placed, seen, "inner")


def bilinear_samples(points: DataFrame, pixels: DataFrame) -> DataFrame:
    """Value of the image at each point (point_id, image_id, line, sample), clamped to its edges: a weighted sum over four pixels. Each pixel's row holds its neighbours below and to the right, so that a point meets one row."""
    size = pixels.groupBy("image_id").agg(F.max("line").cast("double").alias("_h"), F.max("sample").cast("double").alias("_w"))
    corners = F.array(*[F.struct(F.lit(k).alias("k"), (F.col("line").cast("long") - k // 2).alias("l"), (F.col("sample").cast("long") - k % 2).alias("s")) for k in range(4)])
    four = pixels.select("image_id", "value", F.explode(corners).alias("c")).groupBy("image_id", F.col("c.l").alias("_l"), F.col("c.s").alias("_s"))
    four = four.agg(*[F.sum(F.when(F.col("c.k") == k, F.col("value"))).alias(f"_v{k}") for k in range(4)], *[F.bool_or(F.col("c.k") == k).alias(f"_p{k}") for k in range(4)])
    corner = F.array(*[F.struct(F.col(f"_v{k}").alias("value"), F.col(f"_p{k}").alias("present")) for k in range(4)])
    rows = points.join(sized(size), "image_id")
    y, x = (F.least(F.greatest(F.col(c), F.lit(0.0)), F.col(e)) for c, e in (("line", "_h"), ("sample", "_w")))
    rows = rows.select("point_id", "image_id", y.alias("_y"), x.alias("_x"), (F.floor(y) + 1 > F.col("_h")).alias("_low"), (F.floor(x) + 1 > F.col("_w")).alias("_right"), F.floor(y).cast("long").alias("_l"), F.floor(x).cast("long").alias("_s"))
    met = rows.join(sized(materialise(four)), ["image_id", "_l", "_s"])
    fy, fx = F.col("_y") - F.floor("_y"), F.col("_x") - F.floor("_x")

    total, there, known = F.lit(0.0), F.lit(False), F.lit(False)
    for k, w in enumerate(((1 - fy) * (1 - fx), (1 - fy) * fx, fy * (1 - fx), fy * fx)):
        of = F.lit(k)  # a corner beyond the edge is another one of the four
        if k > 1:
            of = F.when(F.col("_low"), of - 2).otherwise(of)
        if k % 2:
            of = F.when(F.col("_right"), of - 1).otherwise(of)
        own = F.get(corner, of)
        total = total + F.coalesce(w * own["value"], F.lit(0.0))
        there, known = there | own["present"], known | own["value"].isNotNull()
    return met.where(there).select("point_id", F.when(known, total).alias("value"))


#: Nanometres of a unit of length.
NM = {"nm": 1.0, "nanometer": 1.0, "nanometers": 1.0, "um": 1e3, "micrometer": 1e3, "micrometers": 1e3, "micron": 1e3, "microns": 1e3}


def to_nm(value: Column, unit: Column) -> Column:
    """Nanometres; null without a unit or with one that isn't known: a bare number is never taken for nanometres."""
    return value * F.try_element_at(F.create_map(*[F.lit(x) for kv in NM.items() for x in kv]), F.lower(F.trim(unit)))


#: Terms of a band's spectral regime.
REGIMES = {"reflected": "reflected", "reflectance": "reflected", "solar reflected": "reflected", "emitted": "emitted", "emission": "emitted", "thermal": "emitted", "thermal emitted": "emitted"}


def label_bands(labels: DataFrame) -> DataFrame:
    """labels: label_id, declared_bands (or null), centers and widths (arrays of structs value, unit), bad_bands (array of booleans) and, if there are such columns, filters and regimes (arrays of
    texts). A row per band: label_id, band_number, center_wavelength_nm, fwhm_nm, is_bad_band, spectral_regime (if regimes are given; unknown without a known term) and warnings. Without a declared
    count the longest array tells it; short arrays leave nulls."""
    with_regime = "regimes" in labels.columns
    arrays = ["centers", "widths", "bad_bands", *(c for c in ("filters", "regimes") if c in labels.columns)]
    longest = F.greatest(*[F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0)) for c in arrays])
    n = F.coalesce(F.col("declared_bands"), longest)
    rows = labels.withColumn("_n", n).where("_n > 0").withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_n").cast("int") - 1)))
    center, width = F.get("centers", F.col("_i")), F.get("widths", F.col("_i"))
    nm = [to_nm(q["value"], q["unit"]) for q in (center, width)]
    warn = [F.when(q["value"].isNotNull() & v.isNull(), F.when(q["unit"].isNull(), f"{name}_without_unit").otherwise(f"{name}_unit_unknown")) for name, q, v in zip(("center", "width"), (center, width), nm, strict=True)]
    term = F.regexp_replace(F.lower(F.trim(F.get("regimes", F.col("_i")))), "[_-]", " ") if with_regime else F.lit(None).cast("string")
    regime = F.try_element_at(F.create_map(*[F.lit(x) for kv in REGIMES.items() for x in kv]), term)
    warn.append(F.when((term != "") & regime.isNull(), "regime_unsupported"))
    out = [(F.col("_i") + 1).alias("band_number"), nm[0].alias("center_wavelength_nm"), nm[1].alias("fwhm_nm"), F.get("bad_bands", F.col("_i")).alias("is_bad_band")]
    if with_regime:
        out.append(F.coalesce(regime, F.lit("unknown")).alias("spectral_regime"))
    return rows.select("label_id", *out, F.array_compact(F.array(*warn, F.when(F.col("declared_bands").isNull(), "count_inferred"))).alias("warnings"))
