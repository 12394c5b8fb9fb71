"""Common grids against a plain interpolation, constants and masks."""

from __future__ import annotations

import math

import numpy as np
import pytest

from veldspar.operators import pyramid


def _pixels(spark, image, valid=None):
    h, w = image.shape
    rows = [("a", i, j, float(image[i, j]), True if valid is None else bool(valid[i, j])) for i in range(h) for j in range(w)]
    return spark.createDataFrame(rows, "image_id string, line long, sample long, value double, valid boolean")


def _array(rows, shape):
    out = np.full(shape, np.nan)
    for r in rows.collect():
        out[r["line"], r["sample"]] = r["value"]
    return out


@pytest.mark.parametrize("ratio", [1.5, 2.0, 3.0])
def test_resampling_against_interpolation(spark, ratio):
    image = np.random.default_rng(1).normal(size=(12, 18))
    valid = np.random.default_rng(2).random((12, 18)) > 0.1
    got = pyramid.resampled(_pixels(spark, image, valid), ratio)
    n, m = round(12 / ratio), round(18 / ratio)
    k = pyramid.kernel(0.5 * math.sqrt(ratio * ratio - 1))
    soft = image
    for axis in (0, 1):
        size = soft.shape[axis]
        soft = sum(k[abs(i)] * np.take(soft, np.clip(np.arange(size) + i, 0, size - 1), axis) for i in range(1 - len(k), len(k)))
    ys, xs = (np.arange(n) + 0.5) * ratio - 0.5, (np.arange(m) + 0.5) * ratio - 0.5
    wide = np.stack([np.interp(xs, np.arange(18), r) for r in soft])
    want = np.stack([np.interp(ys, np.arange(12), c) for c in wide.T], 1)
    assert np.allclose(_array(got, (n, m)), want)
    masks = {(r["line"], r["sample"]): r["valid"] for r in got.collect()}
    assert masks == {(i, j): bool(valid[math.floor(i * ratio) : math.ceil((i + 1) * ratio), math.floor(j * ratio) : math.ceil((j + 1) * ratio)].all()) for i in range(n) for j in range(m)}


def test_pairs(spark):
    flat = _pixels(spark, np.full((8, 8), 2.5))
    rows, facts = pyramid.paired_pyramid(flat, flat, 1.0, 2.0, 2, source_sigma=0.8)
    assert {r["value"] for r in rows.collect()} == {2.5} or all(abs(r["value"] - 2.5) < 1e-12 for r in rows.collect())
    assert {(f["level"], f["side"]): (f["ratio"], f["method"], f["provenance"], f["origin_m"]) for f in facts} == {
        (0, "source"): (2.0, "gaussian_blur_before_resample", "instrument_psf", 0.5), (0, "reference"): (1.0, "none", "none", 0.0),
        (1, "source"): (4.0, "gaussian_blur_before_resample", "instrument_psf", 1.5), (1, "reference"): (2.0, "gaussian_blur_before_resample", "gaussian_fallback", 1.0),
    }
    assert rows.groupBy("level", "side").count().where("count in (16, 64, 4)").count() == 4
    with pytest.raises(ValueError, match="whole number"):
        pyramid.resampled(flat, 3.0)
    with pytest.raises(ValueError):
        pyramid.resampled(flat, 0.5)
