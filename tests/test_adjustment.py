"""Adjustments of many jobs against a plain iteration on single systems."""

from __future__ import annotations

import numpy as np
import pytest

from veldspar.operators import adjustment as adj

RECORD = "job_id string, match_id string, role string, line double, cov_yy double, cov_xy double, cov_xx double, covariance_frame string, covariance_calibrated boolean"
OBSERVATION = "job_id string, match_id string, residual_y double, residual_x double, design array<array<double>>"


def _job(name, n, p, seed, wild=0, noise=0.05, design=None):
    rng = np.random.default_rng(seed)
    records, observations = [], []
    for i in range(n):
        a = rng.normal(size=(2, len(p))) if design is None else np.asarray(design(i), float)
        b = a @ p + rng.normal(size=2) * noise + (50.0 if i < wild else 0.0)
        yy, xx = rng.uniform(0.01, 0.1, 2)
        records.append((name, f"m{i}", adj.FITTING if i % 5 else adj.WITHHELD, float(i), float(yy), float(0.3 * np.sqrt(yy * xx)), float(xx), adj.SOURCE_FRAME, True))
        observations.append((name, f"m{i}", float(b[0]), float(b[1]), a.tolist()))
    return records, observations


def _plain(records, observations, delta=1.345, rounds=30):
    """One job's iteration as it is defined, on the whole system."""
    rows = [(r, o) for r, o in zip(records, observations, strict=True) if r[2] == adj.FITTING]
    lower = [np.linalg.cholesky([[r[4], r[5]], [r[5], r[6]]]) for r, _ in rows]
    a = np.stack([np.linalg.solve(c, np.asarray(o[4])) for c, (_, o) in zip(lower, rows, strict=True)])
    b = np.stack([np.linalg.solve(c, np.asarray(o[2:4])) for c, (_, o) in zip(lower, rows, strict=True)])

    def fitted(w):
        s = np.sqrt(w)[:, None]
        return np.linalg.lstsq((a * s[:, :, None]).reshape(-1, a.shape[2]), (b * s).ravel(), rcond=None)[0]

    def huber(p):
        norm = np.linalg.norm(b - a @ p, axis=1)
        return np.where(norm <= delta, 1.0, delta / norm)

    p, w = np.zeros(a.shape[2]), np.ones(len(a))
    for k in range(1, rounds + 1):
        q = fitted(w)
        v = huber(q)
        near = np.linalg.norm(q - p) <= 1e-10 * max(1, np.linalg.norm(q)) and np.abs(v - w).max() <= 1e-10
        p, w = q, v
        if near:
            return fitted(w), k
    return None, rounds


def _tables(spark, jobs):
    records, observations = ([r for j in jobs for r in j[k]] for k in (0, 1))
    return spark.createDataFrame(records, RECORD).repartition(5), spark.createDataFrame(observations, OBSERVATION).repartition(3)


def _three(optional=()):
    return [adj.Parameter(f"p{i}", "px", i in optional) for i in range(3)]


def test_many_jobs_against_plain_iterations(spark):
    jobs = [_job("clean", 200, [2.0, -1.0, 0.5], 1, noise=0.0), _job("wild", 150, [2.0, -1.0, 0.5], 2, wild=12), _job("noisy", 40, [0.1, 3.0, -4.0], 3, noise=0.5), _job("few", 3, [1.0, 2.0, 3.0], 4), _job("one", 1, [1.0, 2.0, 3.0], 5)]
    jobs[4][0][0] = (*jobs[4][0][0][:2], adj.FITTING, *jobs[4][0][0][3:])
    got = adj.fit_adjustment(*_tables(spark, jobs), _three(), adj.Options(rounds=60))
    rows = {r["job_id"]: r for r in got.jobs.collect()}
    for records, observations in jobs[:4]:
        p, rounds = _plain(records, observations, rounds=60)
        r = rows[records[0][0]]
        assert r["accepted"] and np.allclose(r["p"], p, atol=1e-8) and abs(r["iterations"] - rounds) <= 1 and r["parameters"] == ["p0", "p1", "p2"]
    assert rows["one"]["rejection_reason"] == adj.RANK and rows["one"]["p"] is None and rows["one"]["rank"] == 2
    assert np.allclose(rows["clean"]["p"], [2, -1, 0.5], atol=1e-9) and rows["clean"]["fit_n"] == 160 and rows["clean"]["check_n"] == 40 and rows["clean"]["fit_rmse_2d_px"] < 1e-8
    left = {r["match_id"]: r for r in got.residuals.where("job_id = 'wild'").collect()}
    assert len(left) == 150 and all(left[f"m{i}"]["weight"] < 0.1 for i in range(1, 5)) and left["m0"]["weight"] is None and left["m0"]["mahalanobis"] > 100
    records, observations = jobs[1]
    i = 77
    rest = np.asarray(observations[i][2:4]) - np.asarray(observations[i][4]) @ rows["wild"]["p"]
    assert np.allclose([left[f"m{i}"]["residual_y"], left[f"m{i}"]["residual_x"]], rest)
    assert left[f"m{i}"]["mahalanobis"] == pytest.approx(np.linalg.norm(np.linalg.solve(np.linalg.cholesky([[records[i][4], records[i][5]], [records[i][5], records[i][6]]]), rest)))


def test_optional_parameters_leave_in_reverse_order(spark):
    dependent = lambda i: [[1.0, 0.0, 0.0, 0.0], [0.0, 1.0, i, 2.0 * i]]
    level = lambda i: [[1.0, 0.0, 0.0, 0.0], [0.0, 1.0, 3.0, 0.0]]
    jobs = [_job("twice", 30, [1.0, 2.0, 0.5, 0.0], 1, design=dependent), _job("flat", 30, [1.0, 2.0, 0.0, 0.0], 2, design=level)]
    names = [adj.Parameter("a", "px"), adj.Parameter("b", "px"), adj.Parameter("c", "px", True), adj.Parameter("d", "px", True)]
    kept = {r["job_id"]: r for r in adj.fit_adjustment(*_tables(spark, jobs), names).jobs.collect()}
    assert all(not r["accepted"] and r["rejection_reason"] == adj.RANK and len(r["attempts"]) == 1 for r in kept.values())
    got = {r["job_id"]: r for r in adj.fit_adjustment(*_tables(spark, jobs), names, adj.Options(drop_optional=True)).jobs.collect()}
    assert got["twice"]["parameters"] == ["a", "b", "c"] and got["twice"]["dropped"] == ["d"] and [t["reason"] for t in got["twice"]["attempts"]] == [adj.RANK, None]
    assert got["flat"]["parameters"] == ["a", "b"] and sorted(got["flat"]["dropped"]) == ["c", "d"] and [t["rank"] for t in got["flat"]["attempts"]] == [2, 2, 2]
    required = [adj.Parameter(x, "px") for x in "abcd"]
    assert not any(r["accepted"] for r in adj.fit_adjustment(*_tables(spark, jobs), required, adj.Options(drop_optional=True)).jobs.collect())


def test_inputs_that_are_refused(spark):
    good = _job("good", 10, [1.0, 2.0], 1)
    records, observations = _job("bad", 10, [1.0, 2.0], 2)
    edit = lambda row, at, v: (*row[:at], v, *row[at + 1 :])
    records[1], records[2], records[3], records[4], records[6] = edit(records[1], 4, None), edit(records[2], 8, False), edit(records[3], 7, "ground"), edit(records[4], 5, 9.0), edit(records[6], 2, "candidate")
    records.append(records[7])
    observations[8] = edit(observations[8], 4, [[1.0], [2.0]])
    observations[9] = edit(observations[9], 2, float("nan"))
    observations = [*observations[1:], ("bad", "other", 0.0, 0.0, [[1.0, 0.0], [0.0, 1.0]]), observations[5]]
    lonely = ([("check", "m0", adj.WITHHELD, 0.0, None, None, None, None, None)], [("check", "m0", 0.0, 0.0, [[1.0, 0.0], [0.0, 1.0]])])
    got = {r["job_id"]: r for r in adj.fit_adjustment(*_tables(spark, [good, (records, observations), lonely])).jobs.collect()}
    assert got["good"]["accepted"] and got["bad"]["rejection_reason"] == got["check"]["rejection_reason"] == adj.INPUT
    assert got["bad"]["problems"] == sorted(["covariance_missing", "covariance_uncalibrated", "covariance_frame", "covariance_unusable", "role_not_allowed", "record_id_repeated", "design_shape", "residual_not_finite", "observation_missing", "observation_unknown", "observation_repeated"])
    assert got["check"]["problems"] == ["no_fitting_record"]
    empty = adj.fit_adjustment(*_tables(spark, [([], [])]))
    assert empty.jobs.count() == empty.residuals.count() == 0
    with pytest.raises(ValueError):
        adj.fit_adjustment(*_tables(spark, [good]), [adj.Parameter("a", "px"), adj.Parameter("a", "px")])
    with pytest.raises(ValueError):
        adj.Options(condition_limit=1.0)


def test_jobs_decided_whole_against_rounds_over_all(spark, monkeypatch):
    """The same states whether one task decides a job or every round passes over all observations; long jobs beside short ones."""
    dependent = lambda i: [[1.0, 0.0, 0.0], [0.0, 1.0, 3.0]]
    jobs = [_job(f"j{i}", 3 + 7 * i, [2.0, -1.0, 0.5], i, wild=i // 4, noise=0.2) for i in range(14)] + [_job("flat", 30, [1.0, 2.0, 0.0], 2, design=dependent), _job("short", 2, [1.0, 2.0, 3.0], 3)]
    seen = []
    for whole in (4096, 0, 40):
        monkeypatch.setattr(adj, "WHOLE", whole)
        for rounds in (3, 60):
            rows = adj.fit_adjustment(*_tables(spark, jobs), _three((2,)), adj.Options(rounds=rounds, drop_optional=True)).jobs.collect()
            seen.append({r["job_id"]: (r["accepted"], r["rejection_reason"], r["parameters"], r["dropped"], r["rank"], r["iterations"], [(t["reason"], t["rank"], t["iterations"]) for t in r["attempts"]], r["p"], r["information"]) for r in rows})
            assert len(rows) == len(jobs)
    for other in seen[2:]:
        for job, (*state, p, information) in other.items():
            *want, q, expected = seen[seen.index(other) % 2][job]
            assert abs(state[5] - want[5]) <= 1 and state[:5] == want[:5]
            assert (p is None) == (q is None) and (p is None or np.allclose(p, q, atol=1e-8) and np.allclose(information, expected, rtol=1e-5))
    assert {r[1] for r in seen[0].values()} == {None, adj.ROUNDS}


def _shuffled(spark):
    """Rows written to shuffles so far."""
    context = spark.sparkContext
    context._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = context._jsc.sc().statusStore().stageList(None, False, False, context._gateway.new_array(context._jvm.double, 0), context._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_both_tables_are_shuffled_once(spark):
    """What the disk holds grows with the rows shuffled: each record and each observation goes once, whatever is asked of the jobs."""
    jobs = [_job(f"j{i}", 50, [2.0, -1.0, 0.5], i) for i in range(40)]
    records, observations = ([r for j in jobs for r in j[k]] for k in (0, 1))
    tables = spark.createDataFrame(records, RECORD), spark.createDataFrame(observations, OBSERVATION)
    before = _shuffled(spark)
    rows = adj.fit_adjustment(*tables, _three()).jobs.collect()
    assert len(rows) == 40 and all(r["accepted"] and r["fit_n"] == 40 and r["check_n"] == 10 for r in rows)
    assert _shuffled(spark) - before < 1.5 * (len(records) + len(observations))


def test_metrics_of_small_jobs_against_those_of_large_ones(spark, monkeypatch):
    """Metrics that a task reckons for its jobs are those that aggregation gives; alike lines have no correlation."""
    jobs = [_job(f"j{i}", 4 + 9 * i, [2.0, -1.0, 0.5], i, wild=i // 3, noise=0.2) for i in range(8)] + [_job("alike", 30, [2.0, -1.0, 0.5], 9)]
    jobs[-1] = ([(*r[:3], 50000.3, *r[4:]) for r in jobs[-1][0]], jobs[-1][1])
    jobs.append(([(*r[:2], adj.FITTING, *r[3:]) for r in _job("unchecked", 12, [2.0, -1.0, 0.5], 10)[0]], _job("unchecked", 12, [2.0, -1.0, 0.5], 10)[1]))
    seen = []
    for whole in (4096, 0):
        monkeypatch.setattr(adj, "WHOLE", whole)
        seen.append({r["job_id"]: r.asDict() for r in adj.fit_adjustment(*_tables(spark, jobs), _three(), adj.Options(rounds=60)).jobs.collect()})
    names = [k for k in seen[0]["alike"] if k.startswith(("fit_", "check_")) or k in ("loss", "line_to_y", "line_to_x")]
    assert len(names) == 15 and seen[0].keys() == seen[1].keys()
    for job, row in seen[0].items():
        for k in names:
            a, b = row[k], seen[1][job][k]
            assert (a is None) == (b is None) and (a is None or a == pytest.approx(b, rel=1e-6, abs=1e-9)), (job, k, a, b)
    assert seen[0]["alike"]["line_to_y"] is None and seen[0]["unchecked"]["check_n"] is None and seen[0]["j7"]["line_to_y"] is not None
