"""Tiled matching: plans of overlapping tiles, pixels dealt to tiles, a search in every tile, and records in the frame of their level with overlaps resolved.

A tile's pixels are never gathered as an image: the search deals them on to its grid points. Tiles and pixels meet by blocks (an equi-join), whatever
the windows are; the table of tiles is sized before it is broadcast.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veldspar.operators.tiepoints import in_level_frame, tile_duplicates
from veldspar.tables import materialise, sized

#: Edge of the blocks by which tiles and pixels meet.
BLOCK = 64
#: Bytes of a pixel that count against a tile's budget.
PIXEL_BYTES = 8


def plan_tiles(levels: DataFrame, size: int, halo: int) -> DataFrame:
    """levels: pair_id, level, lines, samples. A row per tile of size x size pixels, with its halo cut at the level's edges: pair_id, level, tile_id, origin_line, origin_sample, lines, samples."""
    if size < 1 or halo < 0:
        raise ValueError("tiles of a pixel at least, halos of none at least")
    rows = levels
    for axis, n in (("line", "lines"), ("sample", "samples")):
        rows = rows.withColumn(f"_{axis}", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col(n) / size) - 1)))
        low = F.greatest(F.col(f"_{axis}") * size - halo, F.lit(0))
        high = F.least((F.col(f"_{axis}") + 1) * size + halo, F.col(n))
        rows = rows.withColumns({f"origin_{axis}": low, f"_n_{axis}": high - low})
    name = F.format_string("r%04dc%04d", "_line", "_sample")
    return rows.select("pair_id", "level", name.alias("tile_id"), "origin_line", "origin_sample", F.col("_n_line").alias("lines"), F.col("_n_sample").alias("samples"))


def _blocks(low: Column, n: Column) -> Column:
    return F.sequence(F.floor(low / BLOCK), F.floor((low + n - 1) / BLOCK))


def in_tiles(pixels: DataFrame, tiles: DataFrame, line: str = "origin_line", sample: str = "origin_sample") -> DataFrame:
    """pixels (pair_id, level, line, sample, value, valid) in every tile whose window holds them: image_id (the tile's key), line and sample from the window's corner."""
    wide = tiles.select("key", "pair_id", "level", F.col(line).alias("_l"), F.col(sample).alias("_s"), "lines", "samples")
    wide = wide.withColumn("_bl", F.explode(_blocks(F.col("_l"), F.col("lines")))).withColumn("_bs", F.explode(_blocks(F.col("_s"), F.col("samples"))))
    met = pixels.withColumns({"_bl": F.floor(F.col("line") / BLOCK), "_bs": F.floor(F.col("sample") / BLOCK)}).join(sized(wide), ["pair_id", "level", "_bl", "_bs"])
    at = {"line": F.col("line") - F.col("_l"), "sample": F.col("sample") - F.col("_s")}
    return met.withColumns(at).where("line >= 0 and line < lines and sample >= 0 and sample < samples").select(F.col("key").alias("image_id"), "line", "sample", "value", "valid")


def checked_tiles(tiles: DataFrame, budget_bytes: int | None = None) -> DataFrame:
    """tiles with a key of their own. Raises if an identity (pair_id, level, tile_id) comes twice, an id is blank, a level negative, or both images of a tile exceed the budget."""
    named = {f"ref_origin_{c}": F.coalesce(F.col(f"ref_origin_{c}") if f"ref_origin_{c}" in tiles.columns else F.lit(None), F.col(f"origin_{c}")) for c in ("line", "sample")}
    out = materialise(tiles.withColumns(named).withColumn("key", F.concat_ws("\u0001", F.col("pair_id").cast("string"), F.col("level").cast("string"), "tile_id")))
    large = F.lit(False) if budget_bytes is None else F.col("lines") * F.col("samples") * 2 * PIXEL_BYTES > budget_bytes
    bad = out.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.bool_or(large).alias("large"), F.bool_or(F.coalesce(F.trim("tile_id") == "", F.lit(True)) | (F.col("level") < 0)).alias("odd")).where("n > 1 or large or odd").first()
    if bad:
        raise ValueError(f"tile {bad['key']!r}: " + ("comes twice" if bad["n"] > 1 else "exceeds the memory budget" if bad["large"] else "needs an id and a level from 0"))
    return out


def match_tiles(source: DataFrame, reference: DataFrame, tiles: DataFrame, search: Callable[[DataFrame, DataFrame, DataFrame | None], DataFrame], radius: float = 0.5, priors: DataFrame | None = None, budget_bytes: int | None = None) -> DataFrame:
    """source, reference: pair_id, level, line, sample, value, valid. tiles: as of plan_tiles, with ref_origin_line and ref_origin_sample where the reference's window begins elsewhere. search(source, reference, priors)
    finds matches of images as ncc_search does. priors: pair_id, level, tile_id, prior_line, prior_sample (displacements in the tile's own frame).

    Every record is kept: job_id (the pair), match_id, level, tile_id, line, sample, ref_line, ref_sample (in the level's frame), score, agreement, is_candidate, is_inlier, rejection_reason. What lies
    within radius of a better record in both images is rejected as a duplicate of the overlap, and names the one that stays."""
    at = checked_tiles(tiles, budget_bytes)
    own = None if priors is None else priors.join(at.select("pair_id", "level", "tile_id", F.col("key").alias("image_id")), ["pair_id", "level", "tile_id"]).select("image_id", "prior_line", "prior_sample")
    found = search(in_tiles(source, at), in_tiles(reference, at, "ref_origin_line", "ref_origin_sample"), own)
    rows = found.withColumnRenamed("image_id", "key").join(sized(at.select("key", "pair_id", "level", "tile_id")), "key")
    rows = rows.withColumns({
        "job_id": F.col("pair_id"), "match_id": F.format_string("%s:%06d:%06d", "tile_id", "line", "sample"), "is_inlier": F.lit(False),
        "rejection_reason": F.when(~F.col("is_candidate"), "no valid NCC score in the bounded search region"),
    }).drop("key")
    frame = at.select("pair_id", "level", "tile_id", "origin_line", "origin_sample", "ref_origin_line", "ref_origin_sample")
    rows = materialise(in_level_frame(rows, frame, ["pair_id"]).drop("pair_id"))
    return tile_duplicates(rows, radius)


def tile_counts(tiles: DataFrame, records: DataFrame) -> DataFrame:
    """Per pair: tiles attempted, tiles with a record, records accepted and rejected."""
    n = tiles.groupBy(F.col("pair_id").alias("job_id")).agg(F.count(F.lit(1)).alias("tiles_attempted"))
    seen = records.groupBy("job_id", "level", "tile_id").agg(F.count_if(F.col("rejection_reason").isNull()).alias("a"), F.count(F.lit(1)).alias("n"))
    counts = seen.groupBy("job_id").agg(F.count(F.lit(1)).alias("tiles_with_candidates"), F.sum("a").alias("accepted"), F.sum(F.col("n") - F.col("a")).alias("rejected"))
    return n.join(counts, "job_id", "left").na.fill(0, ["tiles_with_candidates", "accepted", "rejected"])


def passed_down(records: DataFrame, tiles: DataFrame, ratio: float) -> DataFrame:
    """Priors of the next finer level's tiles from accepted records of a coarser one: the mean displacement, in finer pixels and relative to the tile's windows, of the records whose source lies in
    the tile. Tiles that hold none get no row."""
    moved = {c: F.col(c) * ratio for c in ("line", "sample", "ref_line", "ref_sample")}
    at = records.where("rejection_reason is null").select(F.col("job_id").alias("pair_id"), *(c.alias(k) for k, c in moved.items()))
    at = at.withColumns({"_bl": F.floor(F.col("line") / BLOCK), "_bs": F.floor(F.col("sample") / BLOCK)})
    ref = {f"_ref_{c}": F.coalesce(F.col(f"ref_origin_{c}") if f"ref_origin_{c}" in tiles.columns else F.lit(None), F.col(f"origin_{c}")) for c in ("line", "sample")}
    wide = tiles.withColumns(ref).withColumn("_bl", F.explode(_blocks(F.col("origin_line"), F.col("lines")))).withColumn("_bs", F.explode(_blocks(F.col("origin_sample"), F.col("samples"))))
    met = at.join(sized(wide), ["pair_id", "_bl", "_bs"])
    inside = (F.col("line") >= F.col("origin_line")) & (F.col("line") < F.col("origin_line") + F.col("lines")) & (F.col("sample") >= F.col("origin_sample")) & (F.col("sample") < F.col("origin_sample") + F.col("samples"))
    off = lambda c: F.avg(F.col(f"ref_{c}") - F.col(f"_ref_{c}") - (F.col(c) - F.col(f"origin_{c}"))).alias(f"prior_{c}")
    return met.where(inside).groupBy("pair_id", "level", "tile_id").agg(off("line"), off("sample"))
