"""Robust adjustment of many jobs at once: whitened linear systems, Huber weights, reduction of optional parameters.

A job of at most WHOLE records is decided by one task, many of them side by side in arrays, whatever rounds it takes, and its metrics are reckoned there. For larger ones every round is one pass over the observations of the jobs that aren't decided. A task reduces its rows of a job to a triangular factor (parameters + 1 square), so that rank and
condition are those of the system itself, never of its square; a job's factors meet in one row, whose size depends on the number of tasks, not of observations. A job's state
is a row of a table: iteration, parameters, what is still active and what was tried. A job may have any number of observations.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from veldspar.operators import routes
from veldspar.tables import drop_tables, materialise, recorded, sized

#: The roles that take part, the frame of a covariance, why a system is refused.
FITTING, WITHHELD, SOURCE_FRAME = "fitting_inlier", "withheld_check_point", "source_pixel"
RANK, CONDITION, ROUNDS, INPUT = "rank_deficient", "ill_conditioned", "did_not_converge", "invalid_input"
#: Jobs whose factors a task holds before it sends them on.
HELD = 20_000
#: Records up to which one task decides a job, and numbers that it holds in an array of jobs of one size.
WHOLE, NUMBERS = 4096, 1 << 20


class Parameter(NamedTuple):
    name: str
    unit: str
    optional: bool = False


TRANSLATION = (Parameter("line_translation_px", "px"), Parameter("sample_translation_px", "px"))


@dataclass(frozen=True)
class Options:
    """The defaults."""

    delta: float = 1.345
    rounds: int = 30
    tolerance: float = 1e-10
    weight_tolerance: float = 1e-10
    rank_tolerance: float = 1e-12
    condition_limit: float = 1e10
    least_norm: float = 1e-12
    drop_optional: bool = False

    def __post_init__(self) -> None:
        small = (self.tolerance, self.weight_tolerance, self.rank_tolerance, self.least_norm, self.delta)
        if self.rounds < 1 or not all(math.isfinite(x) and x > 0 for x in small) or not (math.isfinite(self.condition_limit) and self.condition_limit > 1):
            raise ValueError("at least one round, positive tolerances and a condition limit above one")


class Adjustment(NamedTuple):
    """jobs: a row per job; residuals: a row per record of the accepted jobs."""

    jobs: DataFrame
    residuals: DataFrame


def _finite(values: Column) -> Column:
    return F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


#: Problems of one record and of one observation, by bit; what only both sides or a whole job show comes after them.
_OWN = ("record_id_blank", "role_not_allowed", "covariance_missing", "covariance_uncalibrated", "covariance_frame", "covariance_unusable")
_OBSERVED = ("design_shape", "design_not_finite", "residual_not_finite")
PROBLEMS = (*_OWN, *_OBSERVED, "record_id_repeated", "observation_repeated", "observation_missing", "observation_unknown", "no_fitting_record")


def _bits(cases: dict[str, Column]) -> Column:
    said = [F.when(F.coalesce(c, F.lit(False)), F.lit(1 << PROBLEMS.index(name))).otherwise(F.lit(0)) for name, c in cases.items()]
    return reduce(lambda a, x: a.bitwiseOR(x), said)


def _sides(records: DataFrame, observations: DataFrame, n: int) -> DataFrame:
    """Rows of both tables, one below the other: job_id, match_id, mask (bits of PROBLEMS), recorded or observed, fits, line, the covariance, whether it is in source pixels, the residual and the design, number by number (d0 ...)."""
    fitting = F.col("role") == FITTING
    bare = F.col("cov_yy").isNull() | F.col("cov_xy").isNull() | F.col("cov_xx").isNull()
    definite = _finite(F.array("cov_yy", "cov_xy", "cov_xx")) & (F.col("cov_yy") > 0) & (F.col("cov_yy") * F.col("cov_xx") - F.col("cov_xy") * F.col("cov_xy") > 0)
    source = F.coalesce(F.col("covariance_frame") == SOURCE_FRAME, F.lit(False))
    own = _bits({
        "record_id_blank": F.trim(F.coalesce(F.col("match_id").cast("string"), F.lit(""))) == "", "role_not_allowed": ~F.coalesce(F.col("role").isin(FITTING, WITHHELD), F.lit(False)), "covariance_missing": fitting & bare,
        "covariance_uncalibrated": fitting & ~bare & ~F.coalesce(F.col("covariance_calibrated"), F.lit(False)), "covariance_frame": fitting & ~bare & ~source, "covariance_unusable": ~bare & (fitting | source) & ~definite,
    })
    shape = F.coalesce((F.size("design") == 2) & F.forall("design", lambda r: F.coalesce(F.size(r) == n, F.lit(False))), F.lit(False))
    sound = F.coalesce(_finite(F.array("residual_y", "residual_x")), F.lit(False))
    other = _bits({"design_shape": ~shape, "design_not_finite": shape & ~F.coalesce(F.forall("design", _finite), F.lit(False)), "residual_not_finite": ~sound})
    keys, design = ["job_id", "match_id"], {f"d{i * n + j}": F.get(F.get("design", F.lit(i)), F.lit(j)).cast("double") for i in (0, 1) for j in range(n)}
    left = records.select(*keys, own.alias("mask"), F.lit(1).alias("recorded"), F.coalesce(fitting, F.lit(False)).alias("fits"), "line", "cov_yy", "cov_xy", "cov_xx", source.alias("source"))
    right = observations.select(*keys, other.alias("mask"), F.lit(1).alias("observed"), "residual_y", "residual_x", *(c.alias(k) for k, c in design.items()))
    return left.unionByName(right, allowMissingColumns=True)


def _met(sides: DataFrame) -> DataFrame:
    """sides: of _sides. A row per job_id and match_id of either table, with all that its record and its observation say."""
    values = [c for c in sides.columns if c not in ("job_id", "match_id", "mask", "recorded", "observed", "fits")]
    rows = sides.groupBy("job_id", "match_id").agg(
        F.bit_or("mask").alias("mask"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("recorded", "observed")), F.coalesce(F.max("fits"), F.lit(False)).alias("fits"), *(F.max(c).alias(c) for c in values),
    )
    r, o, apart = F.col("recorded") > 0, F.col("observed") > 0, F.col("job_id").isNull() | F.col("match_id").isNull()  # what has no key meets nothing
    more = _bits({"record_id_repeated": F.col("recorded") > 1, "observation_repeated": F.col("observed") > 1, "observation_missing": r & (~o | apart), "observation_unknown": o & (~r | apart)})
    return rows.withColumn("mask", F.col("mask").bitwiseOR(more)).withColumn("recorded", r).drop("observed")


def _named(mask: Column) -> Column:
    """The sorted names of a mask's problems."""
    return F.array_compact(F.array(*(F.when(mask.bitwiseAND(F.lit(1 << PROBLEMS.index(p))) != 0, p) for p in sorted(PROBLEMS))))


def _job_masks(rows: DataFrame) -> DataFrame:
    """rows: of _met. job_id, mask of what keeps the job from being adjusted."""
    jobs = rows.groupBy("job_id").agg(F.bit_or("mask").alias("mask"), F.bool_or("recorded").alias("r"), F.bool_or("fits").alias("f"))
    return jobs.select("job_id", F.col("mask").bitwiseOR(_bits({"no_fitting_record": F.col("r") & ~F.col("f")})).alias("mask"))


def _design(b: pa.RecordBatch, n: int) -> np.ndarray:
    return np.stack([b.column(f"d{i}").to_numpy(zero_copy_only=False).astype(float) for i in range(2 * n)], 1).reshape(b.num_rows, 2, n)


def _white(b: pa.RecordBatch, n: int) -> np.ndarray:
    """Whitened rows [design | residual] (rows x 2 x n + 1): the lower Cholesky factor of each covariance solved for both lines."""
    get = lambda c: b.column(c).to_numpy(zero_copy_only=False).astype(float)
    design = _design(b, n)
    both = np.concatenate([design, np.stack([get("residual_y"), get("residual_x")], 1)[:, :, None]], 2)
    l11 = np.sqrt(get("cov_yy"))
    l21 = get("cov_xy") / l11
    l22 = np.sqrt(get("cov_xx") - l21**2)
    first = both[:, 0] / l11[:, None]
    return np.stack([first, (both[:, 1] - l21[:, None] * first) / l22[:, None]], 1)


def _weights(white: np.ndarray, p: np.ndarray | None, delta: float) -> np.ndarray:
    """Huber weights of the residuals that parameters leave; all one before the first solution."""
    if p is None:
        return np.ones(len(white))
    norm = np.linalg.norm(white[:, :, -1] - white[:, :, :-1] @ p, axis=1)
    return np.where(norm <= delta, 1.0, delta / np.maximum(norm, 1e-300))


def _factors(n: int, delta: float):
    """Per task and job: the triangular factor of the weighted rows, and the largest change of a weight since the round before."""

    def sent(held: dict) -> pa.RecordBatch:
        jobs = list(held)
        return pa.record_batch([pa.array([held[j][0] for j in jobs]), pa.array([held[j][1].ravel().tolist() for j in jobs], pa.list_(pa.float64())), pa.array([held[j][2] for j in jobs], pa.float64())], ["job", "r", "moved"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for b in batches:
            if not b.num_rows:
                continue
            white = _white(b, n)
            code, names = pd.factorize(b.column("job").to_numpy(zero_copy_only=False))
            order = np.argsort(code, kind="stable")
            cuts = np.searchsorted(code[order], np.arange(len(names) + 1))
            for k, job in enumerate(names):
                at = order[cuts[k] : cuts[k + 1]]
                p, before, active, t = (b.column(c)[int(at[0])].as_py() for c in ("p", "before", "active", "t"))
                rows = white[np.ix_(at, [0, 1], [*active, n])]
                now = _weights(rows, None if t == 0 else np.asarray(p), delta)
                moved = np.abs(now - _weights(rows, None if t <= 1 else np.asarray(before), delta)).max()
                flat = (rows * np.sqrt(now)[:, None, None]).reshape(-1, len(active) + 1)
                if job in held:
                    flat, moved = np.concatenate([held[job][1], flat]), max(moved, held[job][2])
                held[job] = (job, np.linalg.qr(flat, mode="r"), float(moved))
            if len(held) > HELD:
                yield sent(held)
                held = {}
        if held:
            yield sent(held)

    return run


class _Solution(NamedTuple):
    p: np.ndarray | None
    information: np.ndarray | None
    rank: int
    condition: float | None
    reason: str | None


def solve(r: np.ndarray, o: Options) -> _Solution:
    """Least squares from a stack of triangular factors [A | b]: columns scaled by their largest entry, singular values for rank and condition; no pseudo-inverse."""
    r = np.linalg.qr(r, mode="r")
    a, b = r[:, :-1], r[:, -1]
    if len(a) < a.shape[1]:
        a, b = np.vstack([a, np.zeros((a.shape[1] - len(a), a.shape[1]))]), np.append(b, np.zeros(a.shape[1] - len(b)))
    size = np.sqrt((a**2).sum(0))
    size = np.where(size > 0, size, 1.0)
    u, s, vt = np.linalg.svd(a / size, full_matrices=False)
    least = o.rank_tolerance * s[0]
    rank = int((s > least).sum())
    if rank < a.shape[1]:
        return _Solution(None, None, rank, None, RANK)
    condition = float(s[0] / s[-1])
    if condition > o.condition_limit:
        return _Solution(None, None, rank, condition, CONDITION)
    return _Solution(vt.T @ ((u.T @ b) / s) / size, (vt.T / s**2) @ vt / size[:, None] / size[None, :], rank, condition, None)


_TRIED = "array<struct<parameters:array<string>,reason:string,rank:int,condition:double,iterations:int>>"
_STATE = f"t int, p array<double>, before array<double>, active array<int>, done boolean, reason string, rank int, condition double, information array<array<double>>, iterations int, attempts {_TRIED}"
_TOLD = "problems array<string>, " + ", ".join(f"{p}_{m} {'long' if m == 'n' else 'double'}" for p in ("fit", "check") for m in ("n", "rmse_y_px", "rmse_x_px", "rmse_2d_px", "median_px", "p90_px")) + ", loss double, line_to_y double, line_to_x double"


def advance(state: dict, factors: list[list[float]], moved: float, parameters: list[Parameter], o: Options) -> dict:
    """A job's state after a round: accepted, refused, reduced by its last optional parameter and begun anew, or one solution further."""
    active, t = state["active"], state["t"]
    width = len(active) + 1
    found = solve(np.concatenate([np.asarray(f).reshape(-1, width) for f in factors]), o)
    p = np.zeros(len(active)) if t == 0 else np.asarray(state["p"])
    before = np.zeros(len(active)) if t <= 1 else np.asarray(state["before"])
    settled = t >= 1 and np.linalg.norm(p - before) <= o.tolerance * max(1.0, np.linalg.norm(p)) and moved <= o.weight_tolerance
    reason = found.reason or (None if settled or t < o.rounds else ROUNDS)
    if reason is None and not settled:
        return {**state, "t": t + 1, "p": found.p.tolist(), "before": p.tolist()}
    tried = {"parameters": [parameters[i].name for i in active], "reason": reason, "rank": found.rank, "condition": found.condition, "iterations": t}
    state = {**state, "attempts": [*state["attempts"], tried], "rank": found.rank, "condition": found.condition, "iterations": t, "reason": reason}
    if reason is None:
        return {**state, "done": True, "p": found.p.tolist(), "before": None, "information": found.information.tolist()}
    optional = [i for i in active if parameters[i].optional]
    if o.drop_optional and reason in (RANK, CONDITION) and optional and len(active) > 1:
        return {**state, "t": 0, "p": None, "before": None, "active": [i for i in active if i != optional[-1]]}
    return {**state, "done": True, "p": None, "before": None}


def _decided(white: np.ndarray, counts: np.ndarray, parameters: list[Parameter], o: Options) -> list[dict]:
    """States of jobs whose whitened rows follow one another: the rounds of `advance` on all of them at once, empty rows filling up what is shorter."""
    n, states = len(parameters), [{} for _ in counts]
    m = int(max(counts.max(), n + 1))
    job = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(len(white)) - np.repeat(np.cumsum(counts) - counts, counts)
    held, there = np.zeros((len(counts), m, 2, n + 1)), np.zeros((len(counts), m), bool)
    held[job, place], there[job, place] = white, True
    attempts: list[list] = [[] for _ in counts]
    todo = [(tuple(range(n)), np.arange(len(counts)))]
    while todo:
        active, live = todo.pop()
        k, t = len(active), 0
        p, before = np.zeros((len(live), k)), np.zeros((len(live), k))
        dropped: dict[tuple, list] = {}
        rows, real = held[live][..., [*active, n]], there[live]

        def weights(q, rows=rows):
            norm = np.linalg.norm(rows[..., -1] - (rows[..., :-1] @ q[:, None, :, None])[..., 0], axis=2)
            return np.where(norm <= o.delta, 1.0, o.delta / np.maximum(norm, 1e-300))

        old = np.ones(real.shape)
        while len(live):
            now = weights(p, rows) if t else np.ones(real.shape)
            moved = np.where(real, np.abs(now - old), 0.0).max(1)
            r = np.linalg.qr((rows * np.sqrt(now)[:, :, None, None]).reshape(len(live), -1, k + 1), mode="r")
            a, b = r[:, :, :-1], r[:, :, -1]
            size = np.sqrt((a**2).sum(1))
            size = np.where(size > 0, size, 1.0)
            u, s, vt = np.linalg.svd(a / size[:, None, :], full_matrices=False)
            rank = (s > o.rank_tolerance * s[:, :1]).sum(1)
            with np.errstate(divide="ignore", invalid="ignore"):
                condition = s[:, 0] / s[:, -1]
                v = vt.transpose(0, 2, 1)
                found = (v @ (((u.transpose(0, 2, 1) @ b[:, :, None])[..., 0] / s)[..., None]))[..., 0] / size
                information = (v / s[:, None, :] ** 2) @ vt / size[:, :, None] / size[:, None, :]
            settled = (t >= 1) & (np.linalg.norm(p - before, axis=1) <= o.tolerance * np.maximum(1.0, np.linalg.norm(p, axis=1))) & (moved <= o.weight_tolerance)
            poor, loose = rank < k, condition > o.condition_limit
            ended = poor | loose | settled | (t >= o.rounds)
            for i in np.flatnonzero(ended):
                at = int(live[i])
                reason = RANK if poor[i] else CONDITION if loose[i] else None if settled[i] else ROUNDS
                told = {"reason": reason, "rank": int(rank[i]), "condition": None if poor[i] else float(condition[i]), "iterations": t}
                attempts[at].append({"parameters": [parameters[j].name for j in active], **told})
                optional = [j for j in active if parameters[j].optional]
                if o.drop_optional and reason in (RANK, CONDITION) and optional and k > 1:
                    dropped.setdefault(tuple(j for j in active if j != optional[-1]), []).append(at)
                    continue
                done = {"p": found[i].tolist(), "information": information[i].tolist()} if reason is None else {"p": None, "information": None}
                states[at] = {"t": t, "before": None, "active": list(active), "done": True, "attempts": attempts[at], **told, **done}
            on = ~ended
            live, rows, real, old, before, p, t = live[on], rows[on], real[on], now[on], p[on], found[on], t + 1
        todo += [(a, np.asarray(jobs)) for a, jobs in dropped.items()]
    return states


_METRICS = ("n", "rmse_y_px", "rmse_x_px", "rmse_2d_px", "median_px", "p90_px")


def _measured(code: np.ndarray, jobs: int, dy: np.ndarray, dx: np.ndarray) -> list[np.ndarray]:
    """_METRICS of jobs whose rows are sorted by code; where a job has none, n is 0."""
    n = np.bincount(code, minlength=jobs)
    mean = lambda v: np.bincount(code, v, jobs) / np.maximum(n, 1)
    e, begin = np.hypot(dy, dx), np.cumsum(n) - n
    e = e[np.lexsort((e, code))]

    def quantile(q: float) -> np.ndarray:
        if not len(e):
            return np.zeros(jobs)
        at = q * np.maximum(n - 1, 0)
        low, high = np.floor(at), np.ceil(at)
        a, b = (e[np.minimum(begin + x.astype(int), len(e) - 1)] for x in (low, high))
        return np.where(low == high, a, (high - at) * a + (at - low) * b)

    return [n, np.sqrt(mean(dy * dy)), np.sqrt(mean(dx * dx)), np.sqrt(mean(dy * dy + dx * dx)), quantile(0.5), quantile(0.9)]


def _correlated(code: np.ndarray, jobs: int, line: np.ndarray, values: tuple[np.ndarray, ...], least: float) -> list[np.ma.MaskedArray]:
    """Correlation of lines with each of the values, job by job; masked below two rows or without variation."""
    n = np.bincount(code, minlength=jobs)
    begin = np.cumsum(n) - n

    def centred(v: np.ndarray) -> np.ndarray:
        v = v - v[begin[code]]  # alike values become zeros exactly
        return v - (np.bincount(code, v, jobs) / np.maximum(n, 1))[code]

    x = centred(line)
    norm = lambda v: np.sqrt(np.bincount(code, v * v, jobs))
    out = []
    for v in map(centred, values):
        a, b = norm(x), norm(v)
        with np.errstate(divide="ignore", invalid="ignore"):
            out.append(np.ma.array(np.bincount(code, x * v, jobs) / (a * b), mask=~((n >= 2) & (a > least) & (b > least))))
    return out


def _whole(n: int, parameters: list[Parameter], o: Options, arrow: pa.Schema):
    """Over rows of _met sorted by job: the state of every job, decided, with its metrics, or why its input is refused."""

    def measured(b: pa.RecordBatch, code: np.ndarray, states: list[dict]) -> list[dict]:
        """Metrics of accepted jobs; code: the job of each row, sorted."""
        p = np.zeros((len(states), n))
        for j, s in enumerate(states):
            if s["reason"] is None:
                p[j, s["active"]] = s["p"]
        get = lambda c: b.column(c).to_numpy(zero_copy_only=False).astype(float)
        rest = np.stack([get("residual_y"), get("residual_x")], 1) - np.einsum("rij,rj->ri", _design(b, n), p[code])
        fits, line = b.column("fits").to_numpy(zero_copy_only=False).astype(bool), get("line")
        found = {}
        for prefix, own in (("fit", fits), ("check", ~fits)):
            n_rows, *values = _measured(code[own], len(states), rest[own, 0], rest[own, 1])
            none = n_rows == 0
            found |= {f"{prefix}_{m}": np.ma.array(v, mask=none) for m, v in zip(_METRICS, (n_rows, *values), strict=True)}
        dy, dx = rest[fits].T
        l11 = np.sqrt(get("cov_yy")[fits])
        l21 = get("cov_xy")[fits] / l11
        norm = np.hypot(dy / l11, (dx - l21 * (dy / l11)) / np.sqrt(get("cov_xx")[fits] - l21 * l21))
        found["loss"] = np.ma.array(np.bincount(code[fits], np.where(norm <= o.delta, 0.5 * norm * norm, o.delta * (norm - 0.5 * o.delta)), len(states)))
        found["line_to_y"], found["line_to_x"] = _correlated(code[fits], len(states), line[fits], (dy, dx), o.least_norm)
        lists = {k: v.tolist() for k, v in found.items()}
        return [{k: v[j] for k, v in lists.items()} if s["reason"] is None else {} for j, s in enumerate(states)]

    def decided(b: pa.RecordBatch, cuts: np.ndarray) -> Iterator[pa.RecordBatch]:
        names = b.column("job").take(pa.array(cuts[:-1])).to_pylist()
        mask = np.bitwise_or.reduceat(b.column("mask").to_numpy(), cuts[:-1])
        any_of = lambda c: np.logical_or.reduceat(b.column(c).to_numpy(zero_copy_only=False).astype(bool), cuts[:-1])
        mask = mask | np.where(any_of("recorded") & ~any_of("fits"), 1 << PROBLEMS.index("no_fitting_record"), 0)
        refused = np.flatnonzero(mask)
        if len(refused):
            yield pa.RecordBatch.from_pylist([{"job": names[j], "reason": INPUT, "problems": sorted(p for i, p in enumerate(PROBLEMS) if mask[j] >> i & 1)} for j in refused], schema=arrow)
        good = np.flatnonzero(mask == 0)
        if not len(good):
            return
        code = np.repeat(np.arange(len(names)), np.diff(cuts))
        fits = b.column("fits").to_numpy(zero_copy_only=False).astype(bool)
        counts = np.bincount(code[fits], minlength=len(names))
        width = np.ceil(np.log2(np.maximum(counts, n + 1))).astype(int)
        for w in np.unique(width[good]):
            alike = good[width[good] == w]
            step = max(1, NUMBERS // ((2 << int(w)) * (n + 1)))
            for jobs in (alike[i : i + step] for i in range(0, len(alike), step)):
                at = np.concatenate([np.arange(cuts[j], cuts[j + 1]) for j in jobs])
                own, fitted = b.take(pa.array(at)), b.take(pa.array(at[fits[at]]))
                states = _decided(_white(fitted, n), counts[jobs], parameters, o)
                extra = measured(own, np.repeat(np.arange(len(jobs)), np.diff(cuts)[jobs]), states)
                yield pa.RecordBatch.from_pylist([{"job": names[j], "problems": [], **s, **m} for j, s, m in zip(jobs, states, extra, strict=True)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry = None
        for b in batches:
            if not b.num_rows:
                continue
            b = b if carry is None else pa.Table.from_batches([carry, b]).combine_chunks().to_batches()[0]
            code = pd.factorize(b.column("job").to_numpy(zero_copy_only=False), use_na_sentinel=False)[0]
            cuts = np.flatnonzero(np.diff(code, prepend=-1))
            carry = b.slice(int(cuts[-1]))
            if len(cuts) > 1:
                yield from decided(b.slice(0, int(cuts[-1])), cuts)
        if carry is not None:
            yield from decided(carry, np.array([0, carry.num_rows]))

    return run


def fit_adjustment(records: DataFrame, observations: DataFrame, parameters: list[Parameter] | tuple[Parameter, ...] = TRANSLATION, options: Options = Options()) -> Adjustment:
    """records: job_id, match_id, role, line, cov_yy, cov_xy, cov_xx (null without covariance), covariance_frame, covariance_calibrated. observations: job_id, match_id, residual_y, residual_x, design (2 x n). Of any number of jobs.
    Both tables are shuffled once, together and by job; a job with more than WHOLE of either goes through rounds of its own.
     jobs: job_id, accepted, rejection_reason (invalid_input with its problems, or why a system was refused), problems, parameters (names used), p, information
    (inverse of the conditional information), iterations, rank, condition, attempts, dropped, loss, the metrics of fitting and withheld records (fit_, check_) and the correlation of residuals with lines.
    residuals: job_id, match_id, role, line, residual_y, residual_x (what the parameters leave), mahalanobis (null without a covariance in source pixels), weight (of fitting records)."""
    names = [p.name for p in parameters]
    if not names or len(set(names)) < len(names) or any(not p.name.strip() or not p.unit.strip() for p in parameters):
        raise ValueError("parameters need names of their own and units, one at least")
    n, parameters = len(names), list(parameters)
    spark = records.sparkSession
    sides = _sides(records, observations, n)
    rows = _met(sides)
    counts = records.select("job_id", F.lit(1).alias("r"), F.lit(0).alias("o")).unionByName(observations.select("job_id", F.lit(0).alias("r"), F.lit(1).alias("o"))).groupBy("job_id").agg(F.sum("r").alias("r"), F.sum("o").alias("o"))
    large = materialise(counts.where(F.greatest("r", "o") > WHOLE).select(F.col("job_id").alias("_job")))
    own = F.col("job_id").eqNullSafe(F.col("_job"))
    values = ("line", "cov_yy", "cov_xy", "cov_xx", "residual_y", "residual_x", *(f"d{i}" for i in range(2 * n)))
    kind = rows.schema["job_id"].dataType
    none = lambda t: F.lit(None).cast(t)
    schema = T.StructType([T.StructField("job", kind), *T._parse_datatype_string(_STATE).fields])
    told = T.StructType([*schema.fields, *T._parse_datatype_string(_TOLD).fields])
    arrow, columns = to_arrow_schema(schema), schema.names
    few = sides if large.isEmpty() else sides.join(sized(large), own, "left_anti")
    few = _met(few.repartition("job_id")).select(F.col("job_id").alias("job"), "mask", "recorded", "fits", *values).sortWithinPartitions("job")  # dealt by job, so that its records meet without another shuffle
    known = materialise(few.mapInArrow(_whole(n, parameters, options, to_arrow_schema(told)), told))
    jobs, accepted = _jobs(known, names), known.where("reason is null").select(F.col("job").alias("job_id"), "p", "active")
    if large.isEmpty():
        return Adjustment(jobs, _residuals(rows, accepted, n, options))
    apart = materialise(_met(sides.join(sized(large), own, "left_semi")))
    masks = materialise(_job_masks(apart))
    bad = masks.where("mask != 0").select("job_id", _named(F.col("mask")).alias("problems"))
    apart = apart.join(sized(masks.where("mask = 0").select("job_id")), "job_id", "left_semi")
    fitting = apart.where("fits").select(F.col("job_id").alias("job"), *values[1:])
    with recorded() as held:
        state = materialise(fitting.select("job").distinct().select(
            "job", F.lit(0).alias("t"), none("array<double>").alias("p"), none("array<double>").alias("before"), F.array(*map(F.lit, range(n))).alias("active"), F.lit(False).alias("done"), none("string").alias("reason"), F.lit(0).alias("rank"),
            none("double").alias("condition"), none("array<array<double>>").alias("information"), F.lit(0).alias("iterations"), F.array().cast(_TRIED).alias("attempts"),
        ))

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [advance({c: r[c] for c in columns}, r["factors"], r["moved"], parameters, options) for r in b.to_pylist()]
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    limit = (options.rounds + 1) * (1 + sum(p.optional for p in parameters))
    for _ in range(limit):
        live = state.where("not done")
        if live.isEmpty():
            break
        with recorded() as made:
            met = fitting.join(sized(live.select("job", "t", "p", "before", "active")), "job")
            sent = met.mapInArrow(_factors(n, options.delta), T.StructType([T.StructField("job", kind), T.StructField("r", T.ArrayType(T.DoubleType())), T.StructField("moved", T.DoubleType())]))
            whole = sent.groupBy("job").agg(F.collect_list("r").alias("factors"), F.max("moved").alias("moved"))  # one small triangle a task
            state = materialise(live.join(whole, "job").mapInArrow(decide, schema).unionByName(state.where("done")))
        drop_tables(spark, held)
        held = made
    found = state.where("reason is null").select(F.col("job").alias("job_id"), "p", "active")
    jobs = jobs.unionByName(_measured_apart(state, materialise(_residuals(apart, found, n, options)), names, options))
    refused = bad.select("job_id", F.lit(False).alias("accepted"), F.lit(INPUT).alias("rejection_reason"), "problems")
    return Adjustment(jobs.unionByName(refused, allowMissingColumns=True), _residuals(rows, accepted.unionByName(found), n, options))


def _residuals(rows: DataFrame, accepted: DataFrame, n: int, o: Options) -> DataFrame:
    """rows: of _met. What the parameters of the accepted jobs leave."""
    left = lambda line: F.aggregate(F.arrays_zip("active", "p"), F.lit(0.0), lambda a, z: a + F.get(F.col("design"), z["active"] + F.lit(line * n)) * z["p"])
    res = rows.join(sized(accepted), "job_id").withColumn("design", F.array(*(f"d{i}" for i in range(2 * n))))
    res = res.withColumns({"residual_y": F.col("residual_y") - left(0), "residual_x": F.col("residual_x") - left(1)})
    l11 = F.sqrt("cov_yy")
    first, l21 = F.col("residual_y") / l11, F.col("cov_xy") / l11
    norm = F.hypot(first, (F.col("residual_x") - l21 * first) / F.sqrt(F.col("cov_xx") - l21 * l21))
    res = res.withColumn("mahalanobis", F.when(F.col("source"), norm)).withColumn("role", F.when(F.col("fits"), FITTING).otherwise(WITHHELD))
    res = res.withColumn("weight", F.when(F.col("fits"), F.when(F.col("mahalanobis") <= o.delta, 1.0).otherwise(o.delta / F.col("mahalanobis"))))
    return res.select("job_id", "match_id", "role", "line", "residual_y", "residual_x", "mahalanobis", "weight")


def _jobs(state: DataFrame, names: list[str]) -> DataFrame:
    """Decided states as rows of jobs, with the columns of _TOLD that they have."""
    name = F.array(*map(F.lit, names))
    told = [c for c in state.columns if c.startswith(("fit_", "check_")) or c in ("loss", "line_to_y", "line_to_x")]
    problems = F.col("problems") if "problems" in state.columns else F.array().cast("array<string>")
    return state.select(
        F.col("job").alias("job_id"), F.col("reason").isNull().alias("accepted"), F.col("reason").alias("rejection_reason"), problems.alias("problems"), F.when(F.col("reason").isNull(), F.transform("active", lambda i: F.get(name, i))).alias("parameters"), "p", "information",
        "iterations", "rank", "condition", "attempts", F.array_except(name, F.transform("active", lambda i: F.get(name, i))).alias("dropped"), *told,
    )


def _measured_apart(state: DataFrame, res: DataFrame, names: list[str], o: Options) -> DataFrame:
    """Rows of jobs with the metrics of their residuals, by aggregation."""
    parts = res.select("job_id", "role", "line", "mahalanobis", F.col("residual_y").alias("dy"), F.col("residual_x").alias("dx"))
    jobs = _jobs(state, names)
    for role, prefix in ((FITTING, "fit"), (WITHHELD, "check")):
        m = routes.residual_metrics(parts.where(F.col("role") == role), ["job_id"])
        jobs = jobs.join(m.select("job_id", *(F.col(c).alias(f"{prefix}_{c}") for c in m.columns if c != "job_id")), "job_id", "left")
    fit = parts.where(F.col("role") == FITTING)
    return jobs.join(fit.groupBy("job_id").agg(F.sum(routes.huber_loss(F.col("mahalanobis"), o.delta)).alias("loss")), "job_id", "left").join(routes.scan_line_correlation(fit, ["job_id"], o.least_norm), "job_id", "left")
