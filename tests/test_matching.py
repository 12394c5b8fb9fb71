"""Operators that SQL can't express: known shifts, known parameters, streams against batches."""

from __future__ import annotations

import numpy as np
import pytest

from veldspar.operators import matching, tiling
from veldspar.streaming import lifecycle


def test_phase_correlation_against_whole_transforms(spark):
    rng = np.random.default_rng(3)
    image = rng.random((23, 30))
    pairs = {1: (image, np.roll(image, (3, -2), (0, 1))), 2: (image, rng.random((23, 30))), 3: (image, image), 4: (image, image)}
    valid = {k: (rng.random((23, 30)) > 0.2, rng.random((23, 30)) > 0.1) for k in pairs}
    valid[3] = (np.zeros((23, 30), bool), valid[3][1])
    rows = [(t, i, j, float(a[i, j]), float(b[i, j]), bool(valid[t][0][i, j]), bool(valid[t][1][i, j])) for t, (a, b) in pairs.items() for i in range(23) for j in range(30)]
    tiles = spark.createDataFrame(rows, "tile_id int, line int, sample int, source double, reference double, source_valid boolean, reference_valid boolean").repartition(3)
    priors = spark.createDataFrame([(2, 4.0, 1.0, 3.0), (4, 0.5, 0.5, 0.1)], "tile_id int, prior_line double, prior_sample double, radius double")
    got = {r["tile_id"]: r for r in matching.phase_correlation(tiles, priors).collect()}
    for t, disc in ((1, None), (2, (4.0, 1.0, 3.0))):
        waves = [np.fft.fft2(np.where(v, x - x[v].mean(), 0.0)) for x, v in zip(pairs[t], valid[t], strict=True)]
        cross = waves[1] * np.conj(waves[0])
        size = np.abs(cross)
        surface = np.abs(np.fft.ifft2(np.where(size > np.finfo(float).eps, cross / size, 0)))
        dy, dx = (np.where(np.arange(n) <= n // 2, np.arange(n), np.arange(n) - n) for n in (23, 30))
        near = np.ones_like(surface, bool) if disc is None else (dy[:, None] - disc[0]) ** 2 + (dx[None, :] - disc[1]) ** 2 <= disc[2] ** 2
        i, j = np.unravel_index(np.where(near, surface, -1).argmax(), surface.shape)
        rest = surface[near].copy()
        rest[rest.argmax()] = 0
        r = got[t]
        assert (r["dy"], r["dx"], r["status"]) == (dy[i], dx[j], "ok") and r["score"] == pytest.approx(surface[i, j] / rest.mean(), rel=1e-6) and r["ref_line"] == 11 + dy[i]
        assert r["residual"] == (None if disc is None else pytest.approx(np.hypot(dy[i] - disc[0], dx[j] - disc[1])))
    assert (got[1]["dy"], got[1]["dx"]) == (3, -2) and got[3]["status"] == "no_valid_pixel" and got[4]["status"] == "no_displacement" and got[4]["dy"] is None
    assert matching.phase_correlation(tiles.limit(0)).count() == 0


def test_streams_agree_with_batches(spark, tmp_path):
    events = spark.createDataFrame([("r1", 1, "queued"), ("r1", 3, "done"), ("r2", 1, "queued"), ("r1", 2, "running")], "run_id string, version int, state string")
    events.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = lifecycle.latest_states(stream).writeStream.outputMode("complete").format("memory").queryName("states").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.awaitTermination(90)
    got = sorted(map(tuple, spark.table("states").select("run_id", "state", "version", "n_events").collect()))
    assert got == sorted(map(tuple, lifecycle.latest_states(events).select("run_id", "state", "version", "n_events").collect())) == [("r1", "done", 3, 3), ("r2", "queued", 1, 1)]


def test_ncc_search_rejects_and_follows_the_prior(spark):
    rng = np.random.default_rng(3)
    image = rng.normal(size=(24, 24))
    px = lambda valid, dy, dx: [("a", i + dy, j + dx, float(image[i, j]), valid) for i in range(24) for j in range(24)]
    cols = "image_id string, line long, sample long, value double, valid boolean"
    source = spark.createDataFrame(px(True, 0, 0), cols)
    found = matching.ncc_search(source, spark.createDataFrame(px(True, 7, -5), cols), 8, 2, 1.5, (6.6, -4.6)).collect()
    assert found and all(r["is_candidate"] and (r["ref_line"], r["ref_sample"]) == (r["line"] + 7, r["sample"] - 5) and r["score"] > 0.999 for r in found)
    none = matching.ncc_search(source, spark.createDataFrame(px(False, 0, 0), cols), 8, 2, 2.0).collect()
    assert len(none) == len(found) == 4 and all(not r["is_candidate"] and r["score"] == -1 and r["agreement"] is None for r in none)
    assert matching.ncc_search(source.limit(0), source.limit(0), 8, 2, 2.0).count() == 0


def test_tiles_and_priors(spark):
    levels = spark.createDataFrame([("p", 1, 50, 30), ("p", 0, 100, 60)], "pair_id string, level int, lines long, samples long")
    tiles = tiling.plan_tiles(levels, 32, 4)
    got = {(r["level"], r["tile_id"]): (r["origin_line"], r["origin_sample"], r["lines"], r["samples"]) for r in tiles.collect()}
    assert got[1, "r0000c0000"] == (0, 0, 36, 30) and got[1, "r0001c0000"] == (28, 0, 22, 30) and got[0, "r0001c0001"] == (28, 28, 40, 32) and len(got) == 2 + 8
    records = spark.createDataFrame([("p", 10.0, 5.0, 12.0, 4.0, None), ("p", 10.0, 25.0, 14.0, 24.0, None), ("p", 9.0, 5.0, 99.0, 99.0, "no")], "job_id string, line double, sample double, ref_line double, ref_sample double, rejection_reason string")
    down = {r["tile_id"]: (r["prior_line"], r["prior_sample"]) for r in tiling.passed_down(records, tiles.where("level = 0"), 2.0).collect()}
    assert down == {"r0000c0000": (4.0, -2.0), "r0000c0001": (8.0, -2.0)}  # the first lies at (20, 10), the other at (20, 50)
    for bad in (tiles.union(tiles.limit(1)), tiles.selectExpr("pair_id", "level", "' ' AS tile_id", "origin_line", "origin_sample", "lines", "samples")):
        with pytest.raises(ValueError):
            tiling.checked_tiles(bad)
    with pytest.raises(ValueError, match="budget"):
        tiling.checked_tiles(tiles, 1000)


def test_tiles_follow_their_priors(spark):
    rng = np.random.default_rng(4)
    image = rng.normal(size=(40, 40))
    rows = [("p", 0, i, j, float(image[i, j]), True) for i in range(40) for j in range(40)]
    source = spark.createDataFrame(rows, "pair_id string, level int, line long, sample long, value double, valid boolean")
    reference = source.withColumns({"line": source.line + 6, "sample": source["sample"] - 4})
    tiles = tiling.plan_tiles(spark.createDataFrame([("p", 0, 40, 40)], "pair_id string, level int, lines long, samples long"), 20, 6)
    priors = tiles.selectExpr("pair_id", "level", "tile_id", "6.0D AS prior_line", "-4.0D AS prior_sample")
    found = lambda p: tiling.match_tiles(source, reference, tiles, lambda s, r, q: matching.ncc_search(s, r, 5, 2, 1.0, priors=q), priors=p)
    with_prior = found(priors).collect()
    sure = [r for r in with_prior if r["score"] > 0.99]  # the others' places lie outside their tile
    assert len(sure) > 10 and all((r["ref_line"], r["ref_sample"]) == (r["line"] + 6, r["sample"] - 4) for r in sure)
    assert all(r["score"] < 0.99 for r in found(None).collect())
    counts = tiling.tile_counts(tiles, found(priors)).first()
    assert counts["tiles_attempted"] == counts["tiles_with_candidates"] == 4 and counts["accepted"] == sum(r["rejection_reason"] is None for r in with_prior) and counts["accepted"] + counts["rejected"] == len(with_prior)
