"""Matching operators: correlation searches around grid points and phase correlation per tile."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veldspar.tables import materialise, sized


def _rows(rows: DataFrame, by: str, along: str, values: tuple[str, ...]) -> DataFrame:
    """tile_id, by, and the values of a line of a tile as arrays in the order of `along`."""
    held = rows.groupBy("tile_id", by).agg(F.sort_array(F.collect_list(F.struct(along, *values))).alias("c"))  # one line
    return held.select("tile_id", by, *(F.col(f"c.{v}").alias(v) for v in values))


def _transformed(rows: DataFrame, by: str, to: str, arrays: tuple[str, ...], out: tuple[str, ...], step) -> DataFrame:
    """Every line's arrays through step (numpy arrays to numpy arrays), opened again: tile_id, by, `to` (the place along the line) and the values that come out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [step(*(np.asarray(b.column(c)[i].values.to_numpy(zero_copy_only=False), float) for c in arrays)) for i in range(b.num_rows)]
            if found:
                lists = [pa.array([f[k].tolist() for f in found], pa.list_(pa.float64())) for k in range(len(out))]
                yield pa.record_batch([b.column("tile_id"), b.column(by), *lists], ["tile_id", by, *out])

    kind = dict(rows.dtypes)
    done = rows.mapInArrow(run, f"tile_id {kind['tile_id']}, {by} {kind[by]}, " + ", ".join(f"{c} array<double>" for c in out))
    return done.select("tile_id", by, F.posexplode(F.arrays_zip(*out)).alias(to, "v")).select("tile_id", by, to, *(F.col(f"v.{c}").alias(c) for c in out))


def phase_correlation(tiles: DataFrame, priors: DataFrame | None = None) -> DataFrame:
    """tiles: tile_id, line, sample (whole grids from 0), source, reference, source_valid, reference_valid. priors: tile_id, prior_line, prior_sample, radius (at the tile's centre). Gives tile_id, status (ok; no_valid_pixel where a side has
    none; no_displacement where the disc around the prior holds no whole one), dy, dx (reference minus source), line and sample (the centre), ref_line, ref_sample, score = peak over the mean of the other
    magnitudes of the disc (the peak counts as zero), residual (distance of the displacement from the prior).

    Transforms go line by line: rows, then columns, the normalised cross power, columns back, rows back. A task holds a line of a tile, never the tile."""
    sides = {"source": "source_valid", "reference": "reference_valid"}
    on = {s: F.coalesce(F.col(v), F.lit(False)) & F.col(s).isNotNull() & ~F.isnan(s) for s, v in sides.items()}
    mean = tiles.groupBy("tile_id").agg(*(F.avg(F.when(on[s], F.col(s))).alias(f"m_{s}") for s in sides), (F.max("line") + 1).alias("h"), (F.max("sample") + 1).alias("w"))
    mean = materialise(mean)
    at = tiles.join(sized(mean.where("m_source is not null and m_reference is not null")), "tile_id")
    centred = at.select("tile_id", "line", "sample", *(F.when(on[s], F.col(s).cast("double") - F.col(f"m_{s}")).otherwise(0.0).alias(s) for s in sides))
    eps = float(np.finfo(np.float64).eps)

    def across(a, b):
        fa, fb = np.fft.fft(a), np.fft.fft(b)
        return fa.real, fa.imag, fb.real, fb.imag

    def down_and_back(ar, ai, br, bi):
        cross = np.fft.fft(br + 1j * bi) * np.conj(np.fft.fft(ar + 1j * ai))
        size = np.abs(cross)
        back = np.fft.ifft(np.divide(cross, size, out=np.zeros_like(cross), where=size > eps))
        return back.real, back.imag

    wave = ("ar", "ai", "br", "bi")
    rows = _transformed(_rows(centred, "line", "sample", ("source", "reference")), "line", "u", ("source", "reference"), wave, across)
    columns = _transformed(_rows(rows, "u", "line", wave), "u", "y", wave, ("re", "im"), down_and_back)
    surface = _transformed(_rows(columns, "y", "u", ("re", "im")), "y", "x", ("re", "im"), ("value",), lambda re, im: (np.abs(np.fft.ifft(re + 1j * im)),))
    signed = lambda c, n: F.when(F.col(c) <= F.floor(F.col(n) / 2), F.col(c)).otherwise(F.col(c) - F.col(n))
    surface = surface.join(sized(mean.select("tile_id", "h", "w")), "tile_id").withColumns({"dy": signed("y", "h"), "dx": signed("x", "w")})
    none = {c: F.lit(None).cast("double") for c in ("prior_line", "prior_sample", "radius")}
    surface = surface.withColumns(none) if priors is None else surface.join(sized(priors.select("tile_id", *none)), "tile_id", "left")
    off = lambda c, p: F.col(c) - F.coalesce(F.col(p), F.lit(0.0))
    inside = F.col("radius").isNull() | (off("dy", "prior_line") * off("dy", "prior_line") + off("dx", "prior_sample") * off("dx", "prior_sample") <= F.col("radius") * F.col("radius"))
    near = surface.where(inside)
    best = near.groupBy("tile_id").agg(F.min(F.struct((-F.col("value")).alias("v"), "y", "x", "dy", "dx", *none)).alias("b"), F.sum("value").alias("total"), F.count(F.lit(1)).alias("n"))
    peak = -F.col("b.v")
    out = mean.join(best, "tile_id", "left")
    status = F.when(F.col("m_source").isNull() | F.col("m_reference").isNull(), "no_valid_pixel").when(F.col("n").isNull(), "no_displacement").otherwise("ok")
    centre = {"line": (F.col("h") - 1) / 2, "sample": (F.col("w") - 1) / 2}
    return out.select(
        "tile_id", status.alias("status"), F.col("b.dy").cast("double").alias("dy"), F.col("b.dx").cast("double").alias("dx"), *(v.alias(k) for k, v in centre.items()), (centre["line"] + F.col("b.dy")).alias("ref_line"), (centre["sample"] + F.col("b.dx")).alias("ref_sample"),
        F.when(F.col("n").isNotNull(), peak / F.greatest((F.col("total") - peak) / F.col("n"), F.lit(eps))).alias("score"), F.hypot(F.col("b.dy") - F.col("b.prior_line"), F.col("b.dx") - F.col("b.prior_sample")).alias("residual"),
    )


#: A template or candidate needs more than this share of valid pixels.
LEAST_VALID = 0.5


def _disc_scores(a: np.ndarray, ok: np.ndarray, b: np.ndarray, sound: np.ndarray, there: np.ndarray, ys: np.ndarray, xs: np.ndarray) -> np.ndarray:
    """Masked correlations of a template with the window's patches that begin at (ys, xs), all at once; nan where there is none."""
    patches = [np.lib.stride_tricks.sliding_window_view(x, a.shape)[ys, xs].reshape(len(ys), -1) for x in (b, sound, there)]
    both = patches[1] & ok.ravel()
    n = np.maximum(both.sum(1), 1)[:, None]
    sides = []
    for v in (np.broadcast_to(a.ravel(), both.shape), patches[0]):
        v = np.where(both, v, 0.0)
        sides.append(np.where(both, v - v.sum(1, keepdims=True) / n, 0.0))
    scale = np.sqrt((sides[0] ** 2).sum(1) * (sides[1] ** 2).sum(1))
    usable = patches[2].all(1) & (both.mean(1) > LEAST_VALID) & (scale > np.finfo(float).eps)
    return np.where(usable, (sides[0] * sides[1]).sum(1) / np.where(usable, scale, 1.0), np.nan)


def ncc_search(source: DataFrame, reference: DataFrame, grid: int, half: int, radius: float, prior: tuple[float, float] = (0.0, 0.0), priors: DataFrame | None = None) -> DataFrame:
    """Both: image_id, line, sample, value, valid. A row per grid point of the source whose template lies in the image and is valid
    enough: image_id, line, sample, ref_line, ref_sample, score, agreement, is_candidate.

    The best masked correlation within the disc around the prior wins, the first in line order on ties; without any, the row has
    score -1 at the expected place and is no candidate. priors (image_id, prior_line, prior_sample) go ahead of the common prior. Pixels are
    dealt to the grid points that can see them, so that one group holds one search window, whatever the image's size."""
    reach = half + int(np.ceil(radius)) + 1
    common = {"prior_line": F.lit(float(prior[0])), "prior_sample": F.lit(float(prior[1]))}

    def seen(pixels: DataFrame, side: int, by: int) -> DataFrame:
        rows = pixels.select("image_id", F.col("line").cast("long"), F.col("sample").cast("long"), F.col("value").cast("double"), F.coalesce("valid", F.lit(False)).alias("valid"), F.lit(side).alias("side"))
        if priors is None:
            rows = rows.withColumns(common)
        else:
            rows = rows.join(sized(priors.select("image_id", *common)), "image_id", "left").withColumns({k: F.coalesce(k, v) for k, v in common.items()})
        for axis in ("line", "sample"):
            d = F.rint(f"prior_{axis}") if side else F.lit(0.0)
            lo, hi = F.greatest(F.ceil((F.col(axis) - d - by) / grid), F.lit(0)).cast("long"), F.floor((F.col(axis) - d + by) / grid).cast("long")
            steps = F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<bigint>"))
            rows = rows.withColumn(f"at_{axis}", F.explode(F.transform(steps, lambda k: k * grid)))
        return rows

    both = seen(source, 0, half).unionByName(seen(reference, 1, reach))
    pixel = F.struct("line", "sample", "value", "valid")
    windows = both.groupBy("image_id", "at_line", "at_sample").agg(
        F.collect_list(F.when(F.col("side") == 0, pixel)).alias("template"),  # at most the template's area
        F.collect_list(F.when(F.col("side") == 1, pixel)).alias("window"),  # at most the window's area
        *(F.first(k).alias(k) for k in common),
    ).where(F.size("template") == (2 * half + 1) ** 2)
    flat = [F.col(f"{side}.{c}").alias(f"{side}_{c}") for side in ("template", "window") for c in ("line", "sample", "value", "valid")]
    width, size = 2 * half + 1, 2 * (reach + 1) + 1

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for r in rows.itertuples(index=False):
                a, ok = np.zeros((width, width)), np.zeros((width, width), bool)
                at = np.asarray(r.template_line, int) - r.at_line + half, np.asarray(r.template_sample, int) - r.at_sample + half
                a[at], ok[at] = np.asarray(r.template_value, float), np.asarray(r.template_valid, bool)
                ok &= np.isfinite(a)
                if ok.sum() <= width * width * LEAST_VALID:
                    continue
                want = r.at_line + r.prior_line, r.at_sample + r.prior_sample
                top, left = (int(np.rint(p)) + at - reach - 1 for p, at in zip((r.prior_line, r.prior_sample), (r.at_line, r.at_sample), strict=True))
                b, there, sound = np.zeros((size, size)), np.zeros((size, size), bool), np.zeros((size, size), bool)
                at = np.asarray(r.window_line, int) - top, np.asarray(r.window_sample, int) - left
                b[at], there[at], sound[at] = np.asarray(r.window_value, float), True, np.asarray(r.window_valid, bool)
                sound &= np.isfinite(b)
                ys, xs = np.meshgrid(*(np.arange(int(np.ceil(p - radius)), int(np.floor(p + radius)) + 1) for p in want), indexing="ij")
                disc = (ys - want[0]) ** 2 + (xs - want[1]) ** 2 <= radius**2
                ys, xs = ys[disc], xs[disc]
                scores = _disc_scores(a, ok, np.where(sound, b, 0.0), sound, there, ys - top - half, xs - left - half) if len(ys) else np.zeros(0)
                found = np.flatnonzero(~np.isnan(scores))
                if not len(found):
                    out.append((r.image_id, r.at_line, r.at_sample, *want, -1.0, None, False))
                    continue
                ys, xs, scores = ys[found], xs[found], scores[found]
                k = int(scores.argmax())
                best, ring = float(scores[k]), np.maximum(np.abs(ys - ys[k]), np.abs(xs - xs[k]))
                share = lambda others, by: min(max((best - by(others)) / best, 0.0), 1.0) if len(others) and best > 0 else 0.0  # noqa: B023, E731
                out.append((r.image_id, r.at_line, r.at_sample, float(ys[k]), float(xs[k]), best, min(share(scores[ring > 1], np.max), share(scores[ring == 1], np.mean)), True))
            yield pd.DataFrame(out, columns=["image_id", "line", "sample", "ref_line", "ref_sample", "score", "agreement", "is_candidate"])

    kind = source.schema["image_id"].dataType.simpleString()
    schema = f"image_id {kind}, line long, sample long, ref_line double, ref_sample double, score double, agreement double, is_candidate boolean"
    return windows.select("image_id", "at_line", "at_sample", "prior_line", "prior_sample", *flat).mapInPandas(search, schema)


def gradient_magnitude(pixels: DataFrame) -> DataFrame:
    """The images' own slopes in place of their values: central differences, one-sided at the edges, valid or not."""

    def slope(axis: str, other: str):
        w = Window.partitionBy("image_id", other).orderBy(axis)
        before, after, v = F.lag("value").over(w), F.lead("value").over(w), F.col("value")
        return F.when(before.isNull(), after - v).when(after.isNull(), v - before).otherwise((after - before) / 2)

    rows = pixels.withColumn("_y", slope("line", "sample")).withColumn("_x", slope("sample", "line"))
    return rows.withColumn("value", F.hypot("_y", "_x")).drop("_y", "_x")


def structural_search(source: DataFrame, reference: DataFrame, grid: int, half: int, radius: float, prior: tuple[float, float] = (0.0, 0.0), priors: DataFrame | None = None) -> DataFrame:
    """ncc_search on gradient magnitudes: finds what differs in contrast, reversed contrast included."""
    return ncc_search(gradient_magnitude(source), gradient_magnitude(reference), grid, half, radius, prior, priors)
