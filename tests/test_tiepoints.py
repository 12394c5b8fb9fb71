"""Greedy passes, duplicates and robust fits against plain versions."""

from __future__ import annotations

import math
import random
from itertools import combinations, islice

import numpy as np
import pytest
from pyspark.sql import functions as F

from veldspar.operators import tiepoints


def _plain_greedy(rows, radius):
    """rows: job, id, line, sample, score."""
    kept = []
    for r in sorted(rows, key=lambda r: (-r[4], r[1])):
        if not any(k[0] == r[0] and math.hypot(k[2] - r[2], k[3] - r[3]) <= radius for k in kept):
            kept.append(r)
    return {(r[0], r[1]) for r in kept}


def _greedy(spark, rows, radius):
    df = spark.createDataFrame(rows, "job_id int, match_id string, line double, sample double, score double")
    return {(r["job_id"], r["match_id"]) for r in tiepoints.suppress_non_maxima(df, radius).where("nms_status = 'survived'").collect()}


@pytest.mark.parametrize("rounds,component", [(8, 200_000), (1, 200_000), (2, 40)])
def test_greedy_passes(spark, monkeypatch, rounds, component):
    monkeypatch.setattr(tiepoints, "ROUNDS", rounds)
    monkeypatch.setattr(tiepoints, "COMPONENT", component)
    rng = random.Random(rounds)
    rows = [(rng.randrange(2), f"m{i}", rng.uniform(0, 60), rng.uniform(0, 60), float(rng.randrange(6))) for i in range(250)]
    rows += [(5, f"c{i:03d}", 5.0 * i, 0.0, 100.0 - i) for i in range(30)]  # scores fall along a chain
    assert _greedy(spark, rows, 6.0) == _plain_greedy(rows, 6.0)


def test_a_long_chain_of_falling_scores(spark):
    rows = [(1, f"c{i:04d}", 5.0 * i, 0.0, 5000.0 - i) for i in range(2000)]
    assert _greedy(spark, rows, 6.0) == {(1, f"c{i:04d}") for i in range(0, 2000, 2)}


def test_duplicates_of_chains(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(3), f"m{i}", rng.uniform(0, 80), rng.uniform(0, 80), float(rng.randrange(4))) for i in range(200)]
    up = {(r[0], r[1]): (r[0], r[1]) for r in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in combinations(rows, 2):
        if a[0] == b[0] and math.hypot(a[2] - b[2], a[3] - b[3]) <= 5:
            up[root((a[0], a[1]))] = root((b[0], b[1]))
    best = {}
    for r in rows:
        k = root((r[0], r[1]))
        best[k] = min(best.get(k, (math.inf, "")), (-r[4], r[1]))
    df = spark.createDataFrame(rows, "job_id int, match_id string, line double, sample double, score double")
    got = {(r["job_id"], r["match_id"]) for r in tiepoints.remove_duplicates(df, 5.0).collect()}
    assert got == {(k[0], v[1]) for k, v in best.items()}


@pytest.mark.parametrize("part", [7, 50_000])
def test_robust_affine_in_parts(spark, monkeypatch, part):
    monkeypatch.setattr(tiepoints, "PART", part)
    rng = np.random.default_rng(part)
    rows = []
    for job, n in ((1, 40), (2, 25), (3, 2), (4, 3)):
        for i in range(n):
            x, y = rng.uniform(0, 100, 2)
            off = rng.normal(size=2) * 0.2 + (30 if i % 6 == 5 else 0)
            rows.append((job, f"m{i:02d}", float(i), float(x), float(y), float(2 * x - y + 3 + off[0]), float(x + 0.5 * y - 1 + off[1])))
    df = spark.createDataFrame(rows, "job_id int, match_id string, ord double, line double, sample double, ref_line double, ref_sample double").repartition(3)
    got = {(r["job_id"], r["match_id"]): r for r in tiepoints.robust_affine(df, 1.0).collect()}
    for job in (1, 2, 4):
        own = [r for r in rows if r[0] == job]
        a = np.array([[r[3], r[4], 1] for r in own])
        b = np.array([[r[5], r[6]] for r in own])
        best = None
        for k, three in enumerate(islice(combinations(range(len(own)), 3), 128)):
            if abs(np.linalg.det(a[list(three)])) < 1e-9:
                continue
            off = np.hypot(*(a @ np.linalg.solve(a[list(three)], b[list(three)]) - b).T)
            near = off <= 1.0
            key = (-near.sum(), off[near].sum(), k)
            if best is None or key < best[0]:
                best = (key, near)
        fit = np.linalg.lstsq(a[best[1]], b[best[1]], rcond=None)[0]
        off = np.hypot(*(a @ fit - b).T)
        for r, o in zip(own, off, strict=True):
            assert got[job, r[1]]["residual_px"] == pytest.approx(o, abs=1e-6) and got[job, r[1]]["is_inlier"] == (o <= 1.0)
    assert all("fewer than three" in got[3, m]["rejection_reason"] for m in ("m00", "m01"))


def test_a_job_of_one_part_gives_its_best_trial_alone(spark):
    """Neither models nor counts of all trials become rows."""
    rows = [(j, f"m{i}", float(i), float(i * i % 7), float(i) + (9.0 if i == 1 else 0.0), float(i * i % 7)) for j in (1, 2) for i in range(8)]
    df = spark.createDataFrame(rows, "job_id long, match_id string, line double, sample double, ref_line double, ref_sample double")
    spots = df.selectExpr("job_id", "struct(cast(line AS long) AS at, line AS x, sample AS y, ref_line AS u, ref_sample AS v) AS s").groupBy("job_id").agg({"s": "collect_list"}).toDF("job_id", "spots").selectExpr("job_id", "8L AS n", "spots")
    got = tiepoints._inliers(df, spots, 0.5, 30, 7).collect()
    assert len(got) == 2 and all(r["inliers"] == 7 and abs(r["u_line"] - 1) < 1e-9 for r in got)


def test_pairs_within_a_radius_from_one_shuffle_of_the_rows(spark):
    rng = random.Random(9)
    rows = [(rng.randrange(2), f"m{i:03d}", rng.uniform(-50, 50), rng.uniform(-50, 50), 1.0) for i in range(200)]
    rows += [(3, f"g{y}:{x}", 5.0 * y, 5.0 * x, 1.0) for y in range(-6, 7) for x in range(-6, 7)]  # on the corners of cells, exactly a radius apart
    rows += [(4, "n1", None, 1.0, 1.0), (4, "n2", 1.0, 1.0, 1.0)]
    want = {(a[0], a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[1] != b[1] and None not in (a[2], b[2]) and math.hypot(a[2] - b[2], a[3] - b[3]) <= 5}
    df = spark.createDataFrame(rows, "job_id int, match_id string, line double, sample double, score double").repartition(3)
    pairs = tiepoints.within(df, 5.0)
    found = [(r["job_id"], r["a_match_id"], r["b_match_id"]) for r in pairs.collect()]
    assert len(found) == len(set(found)) and set(found) == want
    assert "ReusedExchange" in pairs._jdf.queryExecution().executedPlan().toString()
    once = [(r["job_id"], *sorted((r["a_match_id"], r["b_match_id"]))) for r in tiepoints.within(df, 5.0, both_ways=False).collect()]
    assert len(once) == len(set(once)) == len(want) / 2


def test_round_trips_whose_forward_rows_stay_in_one_cell(spark):
    rng = random.Random(12)
    spot = lambda: rng.choice((rng.uniform(-60, 60), 24.0 * rng.randrange(-2, 3)))  # noqa: E731  within cells and on their edges
    forward = [(rng.randrange(2), f"m{i:03d}", spot(), spot(), spot(), spot()) for i in range(200)]
    reverse = []
    for i, f in enumerate(forward[:150]):
        reverse.append((f[0], f"r{i}", f[4] + rng.choice((-1.5, 0, 1.5, 0.9)), f[5] + rng.choice((0, 0, 1.1)), f[2] + rng.uniform(-1, 1), f[3] + rng.uniform(-1, 1)))
    forward += [forward[0], (0, "none", 1.0, 1.0, None, 2.0)]  # a row twice, a row without a place
    f = spark.createDataFrame(forward, "job_id int, match_id string, line double, sample double, ref_line double, ref_sample double")
    r = spark.createDataFrame(reverse, "job_id int, rev_id string, ref_line double, ref_sample double, line double, sample double")
    want = []
    for x in forward:
        near = [(math.hypot(x[4] - y[2], x[5] - y[3]), math.hypot(x[2] - y[4], x[3] - y[5]), y[1]) for y in reverse if x[4] is not None and x[0] == y[0]]
        near = [n for n in near if n[0] <= 1.5]
        want.append((*x, min(near)[1] if near else None, None if near and min(near)[1] <= 1 else "round_trip_exceeded" if near else "no_reverse_match"))
    rows = tiepoints.verify_forward_backward(f, r, 1.5, 1.0, "reject")
    key = lambda x: (x[0], x[1])
    got = sorted((tuple(x) for x in rows.collect()), key=key)
    assert [(*x[:6], x[7]) for x in got] == [(*x[:6], x[7]) for x in sorted(want, key=key)]
    assert [x[6] for x in got] == pytest.approx([x[6] for x in sorted(want, key=key)])
    assert rows._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("Exchange hash") == 2  # each side is shuffled once


def test_small_jobs_are_fitted_after_one_shuffle(spark, monkeypatch):
    """Each row is shuffled once, and jobs that a task fits whole get what those in parts get."""
    from tests.test_adjustment import _shuffled

    rng = np.random.default_rng(5)
    rows = []
    for job in range(60):
        for i in range(int(rng.integers(1, 40))):
            x, y = rng.uniform(0, 100, 2)
            off = rng.normal(size=2) * 0.3 + (30 if i % 6 == 5 else 0)
            rows.append((job, f"m{i:02d}", float(x), float(y), float(2 * x - y + 3 + off[0]), float(x + 0.5 * y - 1 + off[1])))
    df = spark.createDataFrame(rows, "job_id int, match_id string, line double, sample double, ref_line double, ref_sample double")
    told = lambda: {(r["job_id"], r["match_id"]): r for r in tiepoints.robust_affine(df, 1.0, seed=3).collect()}
    before = _shuffled(spark)
    whole = told()
    assert len(whole) == len(rows) and _shuffled(spark) - before < 1.5 * len(rows)
    monkeypatch.setattr(tiepoints, "WHOLE", 0)
    for k, r in told().items():
        assert (r["is_inlier"], (r["rejection_reason"] or "")[:30]) == (whole[k]["is_inlier"], (whole[k]["rejection_reason"] or "")[:30])
        assert (r["residual_px"] is None) == (whole[k]["residual_px"] is None) and (r["residual_px"] is None or r["residual_px"] == pytest.approx(whole[k]["residual_px"], abs=1e-6))


def test_verification_broadcasts_only_what_was_counted(spark, monkeypatch):
    """A table's bytes on disk say little of its rows: without the counted broadcasts none is left, whatever the planner's own limit, and the rows are the same."""
    rng = np.random.default_rng(3)
    rows = [(j, f"m{i:03d}", *map(float, (x, y, x + 1, y - 1)), float(rng.integers(0, 9))) for j in range(3) for i, (x, y) in enumerate(rng.uniform(0, 60, (150, 2)))]
    forward = spark.createDataFrame(rows, "job_id int, match_id string, line double, sample double, ref_line double, ref_sample double, score double").withColumn("residual_px", F.lit(0.0)).withColumn("is_inlier", F.lit(True)).withColumn("rejection_reason", F.lit(None).cast("string"))
    reverse = forward.where("score > 3").selectExpr("job_id", "'r' || match_id AS rev_id", "ref_line", "ref_sample", "line", "sample")
    told = lambda: {tuple(r) for r in tiepoints.verify_candidates(forward, reverse, 5.0, 2.0, 6.0, 3.0, seed=7).select("job_id", "match_id", "nms_status", "is_inlier").collect()}
    want = told()
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    monkeypatch.setattr(tiepoints, "sized", lambda df: df.hint("merge"))
    got = told()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    seen = store.executionsList(int(before), 1000)
    assert got == want and {r[2] for r in got} == {"survived", "suppressed"} and seen.size() > 10
    plans = [seen.apply(i).physicalPlanDescription() for i in range(seen.size())]
    assert not [p for p in plans if "BroadcastExchange" in p]
