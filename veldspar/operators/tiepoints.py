"""Relational algebra over tie points: spatial joins, duplicates, non-maximum suppression, fits, coverage."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce
from itertools import combinations, islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veldspar.operators.components import components
from veldspar.tables import drop_tables, materialise, recorded, sized


#: Radii that a cell of a spatial join is wide.
CELL = 4.0


def within(rows: DataFrame, radius: float, line: str = "line", sample: str = "sample", both_ways: bool = True, carry: tuple[str, ...] = ("score",)) -> DataFrame:
    """Pairs of rows of a job within radius, with the columns to carry: an equi-join on cells of CELL radii.

    A row goes to the cells that the square of one radius around it touches, hardly more than one; two rows within radius share a cell. Both sides of the join are the same rows, shuffled once, and a pair
    counts in the first of the cells that both are in alone. Each unordered pair is met once, and mirrored if both ways are asked."""
    cols = ("match_id", line, sample, *carry)
    cell = lambda c, off: F.floor((F.col(c) + F.lit(off * 0.5000001 * radius)) / F.lit(CELL * radius)).cast("long")
    held = rows.select("job_id", *cols, cell(line, -1).alias("li"), cell(sample, -1).alias("lj"), F.explode(F.sequence(cell(line, -1), cell(line, 1))).alias("ci"))
    held = held.select("*", F.explode(F.sequence(cell(sample, -1), cell(sample, 1))).alias("cj"))
    side = lambda s: held.select("job_id", "ci", "cj", *[F.col(c).alias(f"{s}_{c}") for c in (*cols, "li", "lj")])
    gap = F.hypot(F.col(f"a_{line}") - F.col(f"b_{line}"), F.col(f"a_{sample}") - F.col(f"b_{sample}"))
    first = (F.greatest("a_li", "b_li") == F.col("ci")) & (F.greatest("a_lj", "b_lj") == F.col("cj"))
    pairs = side("a").hint("merge").join(side("b"), ["job_id", "ci", "cj"]).where((F.col("a_match_id") < F.col("b_match_id")) & first & (gap <= radius))
    pairs = pairs.select("job_id", *[f"{s}_{c}" for s in "ab" for c in cols])
    if not both_ways:
        return pairs
    sides = F.array(*[F.struct(*[F.col(f"{s}_{c}").alias(f"{o}_{c}") for s, o in zip(order, "ab", strict=True) for c in cols]) for order in ("ab", "ba")])
    return pairs.select("job_id", F.explode(sides).alias("p")).select("job_id", *[f"p.{s}_{c}" for s in "ab" for c in cols])


def remove_duplicates(rows: DataFrame, radius: float) -> DataFrame:
    """Transitive clusters within radius; the survivor has the highest score, then the least id. A chain of any length is one cluster."""
    name = lambda c: F.struct("job_id", F.col(c).alias("match_id"))
    pairs = materialise(within(rows, radius, both_ways=False).select(name("a_match_id").alias("u"), name("b_match_id").alias("v"), F.col("a_score").alias("us"), F.col("b_score").alias("vs")))
    roots = components(pairs.select("u", "v"))
    scored = pairs.select(F.explode(F.array(F.struct("u", "us"), F.struct(F.col("v").alias("u"), F.col("vs").alias("us")))).alias("n"))  # only rows with a neighbour go on
    scored = scored.select(F.col("n.u").alias("node"), F.col("n.us").alias("score")).groupBy("node").agg(F.max("score").alias("score"))
    met = materialise(scored.join(roots.hint("merge"), "node", "left").select("node", F.coalesce("root", "node").alias("root"), "score"))
    best = met.groupBy("root").agg(F.min_by("node", F.struct((-F.col("score")).alias("s"), F.col("node.match_id").alias("m"))).alias("_best"))
    lost = materialise(met.join(best.hint("merge"), "root").where("node != _best").select("node.job_id", "node.match_id"))
    return rows.join(sized(lost), ["job_id", "match_id"], "left_anti")


#: Rounds of a greedy pass before what is left is parted into components, and pairs of a component that one task decides.
ROUNDS, COMPONENT = 8, 200_000


def _decided(pairs: list[tuple]) -> list:
    """The losers of one component's greedy pass: nodes are decided once all their better neighbours are, each pair is looked at once."""
    worse, waits = {}, {}
    for b, w in pairs:
        worse.setdefault(b, []).append(w)
        waits[w] = waits.get(w, 0) + 1
    ready, lost = [n for n in worse if n not in waits], set()
    while ready:
        node = ready.pop()
        for w in worse.get(node, ()):
            if node not in lost:
                lost.add(w)
            waits[w] -= 1
            if not waits[w]:
                ready.append(w)
    return list(lost)


def greedy_losers(pairs: DataFrame) -> DataFrame:
    """pairs: better, worse (distinct, of one total order). The nodes that a greedy pass in that order would suppress, as `loser`.

    In each round a node without a better undecided neighbour survives and its worse neighbours lose; decided nodes leave. After ROUNDS rounds the pairs that are
    left fall into components, and those of at most COMPONENT pairs are decided by one task each, however long their chains; what is larger goes on in rounds. Rounds and losers are tables; their joins are shuffled ones, as the bytes of a file
    tell the planner little of the rows that a broadcast would bring to the driver."""
    spark = pairs.sparkSession
    kind = T.StructType([T.StructField("loser", pairs.schema["worse"].dataType)])
    with recorded() as made:
        left = materialise(pairs.select("better", "worse").distinct())
    out, n = [], 0

    def decide(rows: pd.DataFrame) -> pd.DataFrame:
        node = lambda x: tuple(x.values()) if isinstance(x, dict) else tuple(x)
        return pd.DataFrame({"loser": pd.Series([list(x) for x in _decided([(node(b), node(w)) for b, w in zip(rows.better, rows.worse, strict=True)])], dtype=object)})

    fields = kind["loser"].dataType.fields if isinstance(kind["loser"].dataType, T.StructType) else None
    while not left.isEmpty():
        spent, n = made[-1:], n + 1
        with recorded() as made:
            if n % (ROUNDS + 1) or fields is None:
                top = left.select("better").distinct().join(left.select(F.col("worse").alias("better")).hint("merge"), "better", "left_anti")
                gone = materialise(left.join(top.hint("merge"), "better", "left_semi").select(F.col("worse").alias("loser")).distinct())
                lost = gone.hint("merge")
                left = materialise(left.join(lost, F.col("worse") == F.col("loser"), "left_anti").join(lost, F.col("better") == F.col("loser"), "left_anti"))
                keep = [made[0]]
            else:
                roots = components(left.select(F.col("better").alias("u"), F.col("worse").alias("v")))
                named = left.join(roots.withColumnRenamed("node", "better").hint("merge"), "better", "left").withColumn("root", F.coalesce("root", "better"))
                named = materialise(named.select("better", "worse", F.struct(*(F.col(f"root.{f.name}").alias(f.name) for f in fields)).alias("root")))
                keep = made[-1:]
                small = materialise(named.groupBy("root").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= COMPONENT).select("root"))
                flat = [T.StructField(f.name, f.dataType) for f in fields]
                found = named.join(small.hint("merge"), "root", "left_semi").groupBy("root").applyInPandas(lambda rows: pd.DataFrame(decide(rows).loser.tolist(), columns=[f.name for f in flat]), T.StructType(flat))
                gone = materialise(found.select(F.struct(*(f.name for f in flat)).alias("loser")))
                keep = [made[-1]]
                left = materialise(named.join(small.hint("merge"), "root", "left_anti").select("better", "worse"))
            out.append(gone)
        drop_tables(spark, spent + [p for p in made[:-1] if p not in keep])
    return reduce(DataFrame.unionByName, out) if out else spark.createDataFrame([], kind)


def _node(side: str) -> Column:
    return F.struct("job_id", F.col(f"{side}_match_id").alias("match_id"))


def _oriented(pairs: DataFrame, better: Column) -> DataFrame:
    return pairs.withColumn("better", F.when(better, _node("a")).otherwise(_node("b"))).withColumn("worse", F.when(better, _node("b")).otherwise(_node("a")))


def suppress_non_maxima(rows: DataFrame, radius: float) -> DataFrame:
    """Greedy by score, then id, within a job: survivors suppress later rows within radius. Adds nms_status."""
    first = (F.col("a_score") > F.col("b_score")) | ((F.col("a_score") == F.col("b_score")) & (F.col("a_match_id") < F.col("b_match_id")))
    losers = greedy_losers(_oriented(within(rows, radius, both_ways=False), first)).select("loser.job_id", "loser.match_id", F.lit(True).alias("_lost"))
    return rows.join(sized(losers), ["job_id", "match_id"], "left").withColumn("nms_status", F.when(F.col("_lost"), "suppressed").otherwise("survived")).drop("_lost")


def tile_duplicates(rows: DataFrame, radius: float) -> DataFrame:
    """Marks duplicates from the overlaps of tiles: rows (with ref_line, ref_sample, level, tile_id, rejection_reason, is_candidate, is_inlier) whose source and
    reference places both lie within radius of a better one lose, greedily by score, level (none first), tile and id. Losers stay, rejected, with the
    best winner near them named; rows rejected before neither win nor lose."""
    rank = ("score", "level", "tile_id")
    live = rows.where("rejection_reason is null").select("job_id", "match_id", "line", "sample", "ref_line", "ref_sample", "score", F.coalesce("level", F.lit(-1)).alias("level"), F.coalesce("tile_id", F.lit("")).alias("tile_id"))
    pairs = within(live, radius, both_ways=False, carry=("ref_line", "ref_sample", *rank))
    pairs = pairs.where(F.hypot(F.col("a_ref_line") - F.col("b_ref_line"), F.col("a_ref_sample") - F.col("b_ref_sample")) <= radius)
    key = lambda s: F.struct((-F.col(f"{s}_score")).alias("s"), F.col(f"{s}_level").alias("l"), F.col(f"{s}_tile_id").alias("t"), F.col(f"{s}_match_id").alias("m"))
    pairs = _oriented(pairs, key("a") < key("b")).withColumn("winner_key", F.least(key("a"), key("b")))
    pairs = materialise(pairs.select("better", "worse", "winner_key"))
    losers = materialise(greedy_losers(pairs))
    won = pairs.join(losers, F.col("worse") == F.col("loser"), "left_semi").join(losers, F.col("better") == F.col("loser"), "left_anti")
    named = won.groupBy("worse").agg(F.min("winner_key").alias("w")).select("worse.job_id", "worse.match_id", F.when(F.col("w.t") == "", "untiled").otherwise(F.col("w.t")).alias("_tile"), F.col("w.m").alias("_winner"))
    out = rows.join(named, ["job_id", "match_id"], "left")
    lost = F.col("_winner").isNotNull()
    reason = F.when(lost, F.concat(F.lit("tiled overlap duplicate; retained "), "_tile", F.lit(":"), "_winner", F.lit(" by deterministic score order"))).otherwise(F.col("rejection_reason"))
    flags = {c: F.when(lost, F.lit(False)).otherwise(F.col(c)) for c in ("is_candidate", "is_inlier") if c in rows.columns}
    return out.withColumns({"rejection_reason": reason, **flags}).drop("_tile", "_winner")


def in_level_frame(rows: DataFrame, tiles: DataFrame, keys: list[str] | tuple = ()) -> DataFrame:
    """rows in the pixels of their tile -> pixels of the level: adds the tile's window origin (tiles: tile_id, level, origin_line, origin_sample, and the same for the reference). keys: further columns that name a tile."""
    at = tiles.select("level", "tile_id", *keys, *[F.col(c).alias(f"_{c}") for c in ("origin_line", "origin_sample", "ref_origin_line", "ref_origin_sample")])
    moved = {"line": "_origin_line", "sample": "_origin_sample", "ref_line": "_ref_origin_line", "ref_sample": "_ref_origin_sample"}
    return rows.join(at, ["level", "tile_id", *keys]).withColumns({c: F.col(c) + F.col(o) for c, o in moved.items()}).drop(*moved.values())


def verify_forward_backward(forward: DataFrame, reverse: DataFrame, tolerance: float, most: float, mode: str = "annotate") -> DataFrame:
    """forward: job_id, match_id, line, sample, ref_line, ref_sample. reverse: job_id, rev_id, ref_line, ref_sample (anchor), line, sample.

    The reverse match nearest to the forward's reference point (then by round trip, then id) gives the round-trip error. "annotate"
    keeps rows and fills the error where it is small enough; "reject" adds a reason to misses and excesses."""
    # a forward row stays whole in its own cell; reverse rows go to the cells (sixteen tolerances wide) that they reach, hardly more than one; all steps share the partitioning by cell
    cell = lambda x: F.floor(x / F.lit(16.0 * tolerance)).cast("long")
    reach = lambda c: F.explode(F.sequence(cell(F.col(c) - 1.0000001 * tolerance), cell(F.col(c) + 1.0000001 * tolerance)))
    at = ["job_id", "_ci", "_cj"]
    left = forward.select("job_id", "match_id", F.struct(*(F.col(f"`{c}`") for c in forward.columns)).alias("_f"), cell(F.col("ref_line")).alias("_ci"), cell(F.col("ref_sample")).alias("_cj")).repartition(*at)
    left = left.withColumn("_nth", F.row_number().over(Window.partitionBy(*at, "match_id").orderBy("match_id")))  # of rows that share an id
    right = reverse.select("job_id", "rev_id", *[F.col(c).alias(f"_r_{c}") for c in ("ref_line", "ref_sample", "line", "sample")], reach("ref_line").alias("_ci")).select("*", reach("_r_ref_sample").alias("_cj"))
    gap = lambda line, sample: F.hypot(F.col(f"_f.{line}") - F.col(f"_r_{line}"), F.col(f"_f.{sample}") - F.col(f"_r_{sample}"))
    anchor = gap("ref_line", "ref_sample")
    both = left.join(right.withColumnsRenamed({c: f"_r{c}" for c in at}).hint("merge"), [F.col(c) == F.col(f"_r{c}") for c in at] + [anchor <= tolerance], "left")
    m = F.struct(anchor.alias("anchor"), gap("line", "sample").alias("trip"), F.col("rev_id"))
    best = both.groupBy(*at, "match_id", "_nth").agg(F.first("_f").alias("_f"), F.min(F.when(F.col("_rjob_id").isNotNull(), m)).alias("m"))
    out = best.select(*[F.col(f"_f.`{c}`").alias(c) for c in forward.columns], "m")
    fine = F.col("m.trip") <= most
    if mode == "annotate":
        return out.withColumn("forward_backward_error_px", F.when(fine, F.col("m.trip"))).drop("m")
    reason = F.when(F.col("m").isNull(), "no_reverse_match").when(~fine, "round_trip_exceeded")
    return out.withColumn("forward_backward_error_px", F.col("m.trip")).withColumn("rejection_reason", reason).drop("m")


def affine_normal_fit(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Least-squares affine reference ~ (line, sample) per group from central moments (2 x 2 normal equations); null for fewer than three or collinear points."""
    x, y, c = F.col("line"), F.col("sample"), F.col
    sums = {"n": F.count(F.lit(1)), "mx": F.avg(x), "my": F.avg(y), "vx": F.var_pop(x), "vy": F.var_pop(y), "vxy": F.covar_pop(x, y)}
    for t, name in (("u", "ref_line"), ("v", "ref_sample")):
        sums |= {f"m{t}": F.avg(name), f"x{t}": F.covar_pop(x, c(name)), f"y{t}": F.covar_pop(y, c(name))}
    a = rows.groupBy(*keys).agg(*[e.alias(k) for k, e in sums.items()])
    det = c("vx") * c("vy") - c("vxy") * c("vxy")
    a = a.withColumn("det", F.when((c("n") >= 3) & (det > 1e-12 * c("vx") * c("vy")), det))
    for t in "uv":
        p, q = (c(f"x{t}") * c("vy") - c(f"y{t}") * c("vxy")) / c("det"), (c(f"y{t}") * c("vx") - c(f"x{t}") * c("vxy")) / c("det")
        a = a.withColumns({f"{t}_line": p, f"{t}_sample": q}).withColumn(f"{t}_shift", c(f"m{t}") - c(f"{t}_line") * c("mx") - c(f"{t}_sample") * c("my"))
    return a.select(*keys, c("n").cast("long").alias("n"), *[f"{t}_{k}" for t in "uv" for k in ("line", "sample", "shift")])


_COEFFICIENTS = [f"{t}_{k}" for t in "uv" for k in ("line", "sample", "shift")]


def affine_residual(line: Column, sample: Column, ref_line: Column, ref_sample: Column, of: str = "") -> Column:
    """Distance of the reference place from where the affine columns (with prefix `of`) put the source place."""
    c = lambda n: F.col(f"{of}{n}")
    return F.hypot(c("u_line") * line + c("u_sample") * sample + c("u_shift") - ref_line, c("v_line") * line + c("v_sample") * sample + c("v_shift") - ref_sample)


@lru_cache(maxsize=1024)
def _triples(n: int, trials: int, seed: int | None) -> np.ndarray:
    """Rows (from 0) of each trial's three points among n: the first combinations in order, or seeded random choices."""
    if n < 3:
        return np.zeros((0, 3), np.int64)
    if seed is None:
        return np.array(list(islice(combinations(range(n), 3), trials)), np.int64)
    rng = np.random.default_rng(seed)
    return np.array([rng.choice(n, size=3, replace=False) for _ in range(trials)], np.int64).reshape(-1, 3)


def trial_rows(n: Column, trials: int, seed: int | None) -> Column:
    """The rows (from 0) among n that any trial takes, each once."""

    @F.arrow_udf("array<int>")
    def rows(sizes: pa.Array) -> pa.Array:
        return pa.array([np.unique(_triples(n, trials, seed)).tolist() for n in sizes.to_pylist()], pa.list_(pa.int32()))

    return rows(n)


def _through_three(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """p: trials x 3 points x (x, y, u, v). The affines through the points, and the trials they are of: collinear ones have none."""
    d1, d2 = (p[:, i] - p[:, 0] for i in (1, 2))
    det = d1[:, 0] * d2[:, 1] - d2[:, 0] * d1[:, 1]
    size = np.maximum(np.abs(d1[:, :2]).max(1, initial=0), np.abs(d2[:, :2]).max(1, initial=0))
    trial = np.flatnonzero(np.abs(det) > 1e-12 * size * size)
    d1, d2, det, at, fits = d1[trial], d2[trial], det[trial], p[trial, 0], []
    for t in (2, 3):
        a, b = (d1[:, t] * d2[:, 1] - d2[:, t] * d1[:, 1]) / det, (d1[:, 0] * d2[:, t] - d2[:, 0] * d1[:, t]) / det
        fits += [a, b, at[:, t] - a * at[:, 0] - b * at[:, 1]]
    return np.stack(fits, 1), trial


#: Rows of a job that one task meets with the job's models.
PART = 50_000


def _inliers(rows: DataFrame, spots: DataFrame, threshold: float, trials: int, seed: int | None) -> DataFrame:
    """spots: job_id, n, spots (the rows that trials take: at, x, y, u, v). job_id, trial, inliers, their total residual and the affine: each part of a job's rows comes after the
    job's spots in one sorted stream, whose task makes the models. A job of one part gives its best trial alone, parts of larger ones a row per trial."""
    place = ("line", "sample", "ref_line", "ref_sample")
    fields = ("at", "x", "y", "u", "v")
    sizes = spots.select("job_id", "n", F.ceil(F.col("n") / PART).alias("parts"), *(F.col(f"spots.{f}").alias(f) for f in fields))
    own = sizes.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).withColumns({"kind": F.lit(0), **{c: F.lit(None).cast("double") for c in place}})
    seen = rows.join(sizes.select("job_id", "parts"), "job_id").select("job_id", *place, F.pmod(F.xxhash64("match_id"), F.col("parts")).alias("part"), F.lit(1).alias("kind"))
    both = own.unionByName(seen, allowMissingColumns=True).select("job_id", "part", "kind", "n", "parts", *fields, *place).repartition("job_id", "part").sortWithinPartitions("job_id", "part", "kind")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, one, m, trial, n, total, out = None, True, None, None, None, None, []

        def ended():
            if n is None or not len(n):
                return
            best = np.lexsort((trial, total, -n))[:1] if one else np.arange(len(n))
            out.append(([now[0]] * len(best), trial[best], n[best], total[best], m[best]))

        def sent():
            cells = [pa.array([j for o in out for j in o[0]], kind_of), pa.array(np.concatenate([o[1] for o in out]).astype(np.int32)), *(pa.array(np.concatenate([o[i] for o in out])) for i in (2, 3))]
            fits = np.concatenate([o[4] for o in out])
            out.clear()
            return pa.record_batch([*cells, *(pa.array(fits[:, i]) for i in range(6))], ["job_id", "trial", "inliers", "total", *_COEFFICIENTS])

        for b in batches:
            kind_of = b.schema.field("job_id").type
            keys = list(zip(b.column("job_id").to_pylist(), b.column("part").to_pylist(), strict=True))
            kinds = b.column("kind").to_numpy()
            cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1] or kinds[i] != kinds[i - 1]), len(keys)]
            values = [b.column(c).to_numpy(zero_copy_only=False) for c in place]
            for i, j in zip(cuts, cuts[1:], strict=False):
                if i == j:
                    continue
                if keys[i] != now:
                    ended()
                    now, m, n, total = keys[i], None, None, None
                if kinds[i] == 0:
                    at, *xyuv = (b.column(c)[i].values.to_numpy(zero_copy_only=False) for c in fields)
                    triples = _triples(b.column("n")[i].as_py(), trials, seed)
                    order = np.argsort(at)
                    m, trial = _through_three(np.stack(xyuv, 1)[order[np.searchsorted(at[order], triples)]])
                    one = b.column("parts")[i].as_py() == 1
                    continue
                if m is None:
                    continue
                if n is None:
                    n, total = np.zeros(len(m), np.int64), np.zeros(len(m))
                for s in range(i, j, 8192):
                    a, c, p, q = (z[s : min(s + 8192, j), None] for z in values)
                    off = np.hypot(m[:, 0] * a + m[:, 1] * c + m[:, 2] - p, m[:, 3] * a + m[:, 4] * c + m[:, 5] - q)
                    near = off <= threshold
                    n, total = n + near.sum(0), total + np.where(near, off, 0.0).sum(0)
            if out:
                yield sent()
        ended()
        if out:
            yield sent()

    counted = both.mapInArrow(count, f"job_id {dict(rows.dtypes)['job_id']}, trial int, inliers long, total double, " + ", ".join(f"{c} double" for c in _COEFFICIENTS))
    return counted.groupBy("job_id", "trial").agg(F.sum("inliers").alias("inliers"), F.sum("total").alias("total"), *(F.first(c).alias(c) for c in _COEFFICIENTS))


#: Rows of a job up to which one task fits it whole, and numbers that it holds in an array of jobs of one size.
WHOLE, NUMBERS = 8192, 1 << 20


def _fitted(points: np.ndarray, threshold: float, trials: int, min_inliers: int, seed: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """points: jobs x rows x (x, y, u, v), in order. Each job's inliers of its best trial (-1 without a trial), that trial's affine and the refit (NaN where there is none)."""
    jobs, n = points.shape[:2]
    inliers, tried, refit = np.full(jobs, -1), np.full((jobs, 6), np.nan), np.full((jobs, 6), np.nan)
    if n < 3:
        return inliers, tried, refit
    p = points[:, _triples(n, trials, seed)].reshape(-1, 3, 4)
    found, at = _through_three(p)
    m = np.full((len(p), 6), np.nan)
    m[at] = found
    m = m.reshape(jobs, -1, 6)
    x, y, u, v = (points[:, :, i, None] for i in range(4))
    a, b, c, d, e, f = (m[:, None, :, i] for i in range(6))
    off = np.hypot(a * x + b * y + c - u, d * x + e * y + f - v)
    near = off <= threshold
    count, total = np.where(np.isnan(m[:, :, 0]), -1, near.sum(1)), np.where(near, off, 0.0).sum(1)
    total = np.where(count == count.max(1, keepdims=True), total, np.inf)
    best, own = total.argmin(1), np.arange(jobs)
    inliers, some = count[own, best], count[own, best] >= 0
    tried[some] = m[own, best][some]
    inside = near[own, :, best]
    k = np.maximum(inside.sum(1), 1)
    mean = lambda z: np.where(inside, z, 0.0).sum(1) / k
    mx, my, mu, mv = (mean(points[:, :, i]) for i in range(4))
    gx, gy, gu, gv = (points[:, :, i] - z[:, None] for i, z in enumerate((mx, my, mu, mv)))
    vx, vy, vxy = mean(gx * gx), mean(gy * gy), mean(gx * gy)
    det = vx * vy - vxy * vxy
    with np.errstate(divide="ignore", invalid="ignore"):
        for i, (g, z) in enumerate(((gu, mu), (gv, mv))):
            xu, yu = mean(gx * g), mean(gy * g)
            q, r = (xu * vy - yu * vxy) / det, (yu * vx - xu * vxy) / det
            refit[:, 3 * i : 3 * i + 3] = np.stack([q, r, z - q * mx - r * my], 1)
    refit[~((inliers >= max(min_inliers, 3)) & (det > 1e-12 * vx * vy))] = np.nan
    return inliers, tried, refit


def _fits(threshold: float, trials: int, min_inliers: int, seed: int | None):
    """Over rows sorted by job and place in it: each row with its job's number of rows, inliers, trial and refit; jobs of one size go side by side."""

    def fitted(b: pa.RecordBatch, cuts: np.ndarray) -> pa.RecordBatch:
        points = np.stack([b.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("line", "sample", "ref_line", "ref_sample")], 1)
        size = np.diff(cuts)
        inliers, tried, refit = np.zeros(len(size), np.int64), np.full((len(size), 6), np.nan), np.full((len(size), 6), np.nan)
        for n in np.unique(size):
            alike = np.flatnonzero(size == n)
            step = max(1, NUMBERS // (n * trials))
            for jobs in (alike[i : i + step] for i in range(0, len(alike), step)):
                at = cuts[:-1][jobs][:, None] + np.arange(n)
                inliers[jobs], tried[jobs], refit[jobs] = _fitted(points[at], threshold, trials, min_inliers, seed)
        whole = [np.repeat(z, size, 0) for z in (size.astype(np.int64), inliers, tried, refit)]
        cells = [pa.array(z[:, i], mask=np.isnan(z[:, i])) for z in whole[2:] for i in range(6)]
        return pa.RecordBatch.from_arrays([*b.columns, pa.array(whole[0]), pa.array(whole[1]), *cells], names=[*b.schema.names, "n", "inliers", *(f"t_{c}" for c in _COEFFICIENTS), *_COEFFICIENTS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry = None
        for b in batches:
            if not b.num_rows:
                continue
            b = b if carry is None else pa.Table.from_batches([carry, b]).combine_chunks().to_batches()[0]
            code = pd.factorize(b.column("job_id").to_numpy(zero_copy_only=False))[0]
            cuts = np.flatnonzero(np.diff(code, prepend=-1))
            carry = b.slice(int(cuts[-1]))
            if len(cuts) > 1:
                yield fitted(b.slice(0, int(cuts[-1])), cuts)
        if carry is not None:
            yield fitted(carry, np.array([0, carry.num_rows]))

    return run


def robust_affine(rows: DataFrame, threshold: float, trials: int = 128, min_inliers: int = 3, seed: int | None = None) -> DataFrame:
    """Per job: affines through triples of points, the one with most inliers (then least sum of residuals, then the first), refit on its inliers.

    Row order (ord if there is such a column, then match_id) is part of the semantics. Without a seed the triples are the first `trials` combinations, for which a job's first rows are ranked alone, and inliers are told anew by the
    refit; with one they are seeded choices and the trial's inliers stay. Jobs of at most WHOLE rows are fitted whole, many side by side, after one shuffle of the rows. A larger job's rows are dealt in parts of at most about PART rows, and
    stream past its models (a part of each task), so that no job has to fit in a task. Gives job_id, match_id, residual_px, is_inlier, rejection_reason and the affine."""
    place = {"x": "line", "y": "sample", "u": "ref_line", "v": "ref_sample"}
    order = [c for c in ("ord", "match_id") if c in rows.columns]
    rows = rows.where("job_id is not null").select("job_id", *reversed(order), *[F.col(c).cast("double") for c in place.values()])
    large = materialise(rows.groupBy("job_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > min(WHOLE, PART)))
    few = rows if large.isEmpty() else rows.join(sized(large.select("job_id")), "job_id", "left_anti")
    few = few.repartition("job_id").sortWithinPartitions("job_id", *order).drop("ord")
    fields = [*few.schema.fields, *(T.StructField(c, T.LongType()) for c in ("n", "inliers")), *(T.StructField(c, T.DoubleType()) for c in (*(f"t_{k}" for k in _COEFFICIENTS), *_COEFFICIENTS))]
    out = few.mapInArrow(_fits(threshold, trials, min_inliers, seed), T.StructType(fields))
    if not large.isEmpty():
        apart = _fitted_apart(rows.join(sized(large.select("job_id")), "job_id", "left_semi"), order, large, threshold, trials, min_inliers, seed)
        out = out.unionByName(apart.select(*out.columns))
    fitted = F.col("u_line").isNotNull()
    residual = F.when(fitted, affine_residual(*map(F.col, place.values())))
    by_trial = affine_residual(*map(F.col, place.values()), of="t_") <= threshold
    inlier = F.coalesce(fitted & ((F.col("residual_px") <= threshold) if seed is None else by_trial), F.lit(False))
    reason = (
        F.when(F.col("n") < 3, "robust affine fit did not converge: fewer than three candidate correspondences")
        .when(F.coalesce(F.col("inliers"), F.lit(-1)) < min_inliers, "robust affine fit did not converge: insufficient geometrically consistent candidates")
        .when(~fitted, "robust affine fit did not converge: inlier design is rank deficient")
        .when(~F.col("is_inlier"), F.format_string(f"robust affine residual %.4fpx exceeds residual_threshold_px={threshold:.4f}", F.col("residual_px")))
    )
    return out.withColumn("residual_px", residual).withColumn("is_inlier", inlier).withColumn("rejection_reason", reason).select("job_id", "match_id", "residual_px", "is_inlier", "rejection_reason", *_COEFFICIENTS)


def _fitted_apart(rows: DataFrame, order: list[str], jobs: DataFrame, threshold: float, trials: int, min_inliers: int, seed: int | None) -> DataFrame:
    """rows of large jobs (jobs: job_id, n), each with what _fits adds."""
    place = {"x": "line", "y": "sample", "u": "ref_line", "v": "ref_sample"}
    rows = materialise(rows)
    ranked = rows.withColumn("at", F.row_number().over(Window.partitionBy("job_id").orderBy(*order)))
    if seed is None:  # the first combinations use none but a job's first rows
        first = ranked.where(F.col("at") <= trials + 3)
    else:
        picks = jobs.select("job_id", F.explode(trial_rows(F.col("n").cast("int"), trials, seed)).alias("at"))
        first = ranked.join(picks.withColumn("at", F.col("at") + 1), ["job_id", "at"])
    spot = F.struct((F.col("at") - 1).cast("long").alias("at"), *[F.col(c).alias(n) for n, c in place.items()])
    spots = jobs.where("n >= 3").join(first.groupBy("job_id").agg(F.collect_list(spot).alias("spots")), "job_id")  # at most three rows a trial
    scored = _inliers(rows, spots, threshold, trials, seed)
    best = scored.groupBy("job_id").agg(F.min_by(F.struct("inliers", "trial", *_COEFFICIENTS), F.struct((-F.col("inliers")).alias("less"), "total", "trial")).alias("b"))
    chosen = materialise(best.select("job_id", "b.*"))
    inside = rows.join(sized(chosen.where(F.col("inliers") >= min_inliers)), "job_id").withColumn("r", affine_residual(*map(F.col, place.values())))
    refit = affine_normal_fit(inside.where(F.col("r") <= threshold).select("job_id", *place.values()), ["job_id"]).drop("n")
    tried = chosen.select("job_id", "inliers", *[F.col(c).alias(f"t_{c}") for c in _COEFFICIENTS])
    return rows.join(sized(materialise(jobs.join(tried, "job_id", "left").join(refit, "job_id", "left"))), "job_id")


def verify_candidates(forward: DataFrame, reverse: DataFrame, most: float, dedup_radius: float, nms_radius: float, threshold: float, anchor: float | None = None, trials: int = 128, min_inliers: int = 3, seed: int = 0) -> DataFrame:
    """Round trips annotated, duplicates removed, non-maxima marked, and a seeded robust affine of the survivors (suppressed rows keep null fit columns)."""
    rows = verify_forward_backward(forward, reverse, most / 2 if anchor is None else anchor, most, "annotate")
    with recorded() as made:
        rows = materialise(suppress_non_maxima(remove_duplicates(materialise(rows), dedup_radius), nms_radius))
    drop_tables(rows.sparkSession, made[:-1])
    alive = rows.where("nms_status = 'survived'")
    fit = robust_affine(alive, threshold, trials, min_inliers, seed).drop(*_COEFFICIENTS)
    return rows.drop("residual_px", "is_inlier", "rejection_reason").join(fit.hint("merge"), ["job_id", "match_id"], "left")


def verify_match_candidates(forward: DataFrame, reverse: DataFrame | None, most: float, threshold: float, anchor: float | None = None, trials: int = 128, min_inliers: int = 3) -> DataFrame:
    """Round trips that miss or exceed reject a row; the others are fitted by the first triples in order. Adds error, residual, is_inlier, reason and the affine."""
    rows = forward.drop("residual_px", "is_inlier", "rejection_reason")
    if reverse is None:
        rows = rows.withColumn("forward_backward_error_px", F.lit(None).cast("double")).withColumn("_why", F.lit(None).cast("string"))
    else:
        rows = verify_forward_backward(rows, reverse, most / 2 if anchor is None else anchor, most, "reject").withColumnRenamed("rejection_reason", "_why")
    rows = materialise(rows)
    fit = robust_affine(rows.where("_why is null"), threshold, trials, min_inliers)
    out = rows.join(fit, ["job_id", "match_id"], "left")
    return out.withColumn("rejection_reason", F.coalesce("_why", "rejection_reason")).withColumn("is_inlier", F.coalesce("is_inlier", F.lit(False))).drop("_why")


def warp_prior(samples: DataFrame, keys: list[str], source_variance: float | None = None, reference_variance: float | None = None, floor: float = 1e-6) -> DataFrame:
    """Per group: shift, scales and orientation of the affine source -> reference, and its uncertainty from residuals and projection variances.

    status tells why there is no prior: too few or collinear samples, no degree of freedom without both variances, or an uncertainty at the floor."""
    fit = affine_normal_fit(samples, keys)
    rows = samples.join(fit, keys).withColumn("_r", affine_residual(*[F.col(c) for c in ("line", "sample", "ref_line", "ref_sample")]))
    rms = rows.groupBy(*keys).agg(F.sqrt(F.avg(F.col("_r") * F.col("_r"))).alias("rms"))
    both = source_variance is not None and reference_variance is not None
    spread = ((source_variance or 0.0) + (reference_variance or 0.0)) ** 0.5
    scale, dof = F.hypot("u_line", "v_line"), 2 * F.col("n") - 6
    out = fit.join(rms, keys, "left").withColumn("uncertainty_px", F.hypot("rms", F.lit(spread)))
    status = F.when(F.col("u_line").isNull(), "too_few_samples").when((dof <= 0) & F.lit(not both), "no_degrees_of_freedom").when(F.col("uncertainty_px") <= floor, "uncertainty_at_floor").otherwise("ok")
    angle = F.degrees(F.atan2(F.col("uncertainty_px"), F.greatest(F.lit(1e-12), scale)))
    origin = F.lit("supplied_projection_covariances") if both else F.concat(F.lit("affine_residual_dof_"), dof.cast("string"))
    return out.select(*keys, "n", status.alias("status"), F.col("u_shift").alias("shift_line"), F.col("v_shift").alias("shift_sample"), scale.alias("scale_line"), F.hypot("u_sample", "v_sample").alias("scale_sample"), F.degrees(F.atan2("v_line", "u_line")).alias("orientation_deg"), "uncertainty_px", angle.alias("orientation_uncertainty_deg"), origin.alias("provenance"))


# --- coverage ----------------------------------------------------------------------------------------------------


def cell_of(pos: Column, extent: float, cells: int) -> Column:
    """floor(pos / extent * cells), clamped to the grid; the division comes first."""
    return F.least(F.greatest(F.floor(pos / F.lit(float(extent)) * F.lit(cells)), F.lit(0)), F.lit(cells - 1)).cast("int")


def with_cells(rows: DataFrame, height: float, width: float, grid: int = 8) -> DataFrame:
    return rows.withColumn("row", cell_of(F.col("line"), height, grid)).withColumn("col", cell_of(F.col("sample"), width, grid))


def select_grid_coverage(rows: DataFrame, eligible: DataFrame, floor: float) -> DataFrame:
    """rows: with cells and is_inlier. Of the inliers of each eligible cell the best by (score, id) is selected if it meets the floor; the rest is annotated."""
    rows = rows.join(sized(eligible.select("row", "col", "eligible")), ["row", "col"], "left")
    takes_part = F.coalesce(F.col("is_inlier") & F.col("eligible"), F.lit(False))
    w = Window.partitionBy("job_id", "row", "col", takes_part).orderBy(F.desc("score"), "match_id")
    rows = rows.withColumn("_n", F.row_number().over(w)).withColumn("_part", takes_part)
    chosen = F.col("_part") & (F.col("_n") == 1) & (F.col("score") >= floor)
    why = F.when(~F.col("_part"), None).when(chosen, "selected").when(F.col("_n") == 1, "below_floor").otherwise("outranked")
    return rows.withColumn("selected", chosen).withColumn("rationale", why).drop("_n", "_part")


def uniformity_grid(selected: DataFrame, grid: int = 8) -> DataFrame:
    """Per job, as the console shows it: occupied cells, occupancy of all cells, greatest count in a cell, longest horizontal empty run."""
    cells = selected.where("selected").groupBy("job_id", "row", "col").agg(F.count(F.lit(1)).alias("n"))
    jobs = selected.select("job_id").distinct().select("job_id", F.explode(F.sequence(F.lit(0), F.lit(grid - 1))).alias("row"))
    edges = cells.select("job_id", "row", "col").union(jobs.select("job_id", "row", F.explode(F.array(F.lit(-1), F.lit(grid))).alias("col")))
    w = Window.partitionBy("job_id", "row").orderBy("col")
    runs = edges.withColumn("gap", F.col("col") - F.lag("col").over(w) - 1).groupBy("job_id").agg(F.max("gap").cast("long").alias("longest_empty_run"))
    stats = cells.groupBy("job_id").agg(F.count(F.lit(1)).alias("occupied"), F.max("n").alias("most"))
    out = runs.join(stats, "job_id", "left").withColumn("occupied", F.coalesce("occupied", F.lit(0)).cast("long"))
    return out.withColumn("occupancy", F.col("occupied") / F.lit(float(grid * grid))).withColumn("most", F.coalesce("most", F.lit(0)).cast("long"))
