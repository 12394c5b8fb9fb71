"""Patches, their texture and bilinear samples against plain loops."""

from __future__ import annotations

import math
import random

import pytest

from veldspar.operators import refine


def _image(rng):
    """Two images of 70 x 45 pixels, larger than a block; the second has holes."""
    return {(i, y, x): (rng.uniform(0, 1), rng.random() > 0.2) for i in (1, 2) for y in range(70) for x in range(45) if i == 1 or rng.random() > 0.01}


def _tables(spark, rng, image):
    pixels = spark.createDataFrame([(*k, *v) for k, v in image.items()], "image_id long, line long, sample long, value double, valid boolean")
    points = [(n, rng.randrange(1, 4), rng.uniform(-3, 73), rng.uniform(-3, 48)) for n in range(400)]
    points += [(1000 + n, 1, 31.5 + n % 3, 32.0) for n in range(300)]  # many at a few places, at the corner of blocks
    points += [(2000, 1, None, 3.0)]
    return pixels, points, spark.createDataFrame(points, "point_id long, image_id long, line double, sample double")


def test_patches_and_texture(spark):
    rng = random.Random(5)
    image = _image(rng)
    pixels, points, table = _tables(spark, rng, image)
    rows = refine.patches(table, pixels, 2, 0.7)
    assert "Generate" not in rows._jdf.queryExecution().executedPlan().toString()  # a point stays one row
    got = {r["point_id"]: r for r in rows.collect()}
    textures = {r["point_id"]: r["texture"] for r in refine.textures(table, pixels, 2, 0.7).collect()}
    assert len(got) == len(points)
    seen = set()
    for n, i, line, sample in points:
        cells = [] if line is None else [image.get((i, round(line) + y, round(sample) + x)) for y in range(-2, 3) for x in range(-2, 3)]
        whole = bool(cells) and None not in cells
        share = sum(c[1] for c in cells) / 25 if whole else None
        status = "out_of_bounds" if not whole else "too_few_valid" if share < 0.7 else "ok"
        seen.add(status)
        assert (got[n]["status"], got[n]["valid_fraction"]) == (status, share)
        assert (n in textures) == (status == "ok")
        if status == "ok":
            assert [tuple(c) for c in got[n]["cells"]] == cells
            v = [[cells[5 * y + x][0] for x in range(5)] for y in range(5)]
            low, high = lambda k: max(k - 1, 0), lambda k: min(k + 1, 4)
            slopes = [(((v[high(y)][x] - v[low(y)][x]) / (high(y) - low(y))) ** 2 + ((v[y][high(x)] - v[y][low(x)]) / (high(x) - low(x))) ** 2) for y in range(5) for x in range(5)]
            assert textures[n] == pytest.approx(sum(slopes) / 25)
    assert seen == {"out_of_bounds", "too_few_valid", "ok"}


def test_bilinear_samples(spark):
    rng = random.Random(6)
    image = {k: v for k, v in _image(rng).items() if k[0] == 1}
    pixels, points, table = _tables(spark, rng, image)
    points = [p for p in points if p[2] is not None]
    rows = refine.bilinear_samples(table.where("line is not null"), pixels)
    assert "Generate" not in rows._jdf.queryExecution().executedPlan().toString()  # a point stays one row
    got = {r["point_id"]: r["value"] for r in rows.collect()}
    assert set(got) == {p[0] for p in points if p[1] == 1}
    for n, i, line, sample in points:
        if i == 1:
            y, x = min(max(line, 0), 69), min(max(sample, 0), 44)
            y0, x0 = math.floor(y), math.floor(x)
            at = lambda a, b: image[1, min(a, 69), min(b, 44)][0]
            fy, fx = y - y0, x - x0
            want = (1 - fy) * ((1 - fx) * at(y0, x0) + fx * at(y0, x0 + 1)) + fy * ((1 - fx) * at(y0 + 1, x0) + fx * at(y0 + 1, x0 + 1))
            assert got[n] == pytest.approx(want)
