"""Nearest neighbours: exact ranks and scores, ties, repeated ids and rows, and how much of an index a query looks at."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from veldspar.llm import addq


def _plain(rows, every, k):
    kept = [(i, np.asarray(v, np.float64)) for i, v in rows if i is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = []
    for n, (i, q) in enumerate(kept):
        if i % every == 0:
            near = sorted(((-float((q * v).sum()), j) for m, (j, v) in enumerate(kept) if m != n and len(v) == len(q)), key=lambda x: x)[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(near)]
    return out


def _found(spark, rows, **kw):
    df = spark.createDataFrame([(*r, 7, 1, 0) for r in rows], "vec_id long, embedding array<double>, row int, part int, kind int").repartition(3)
    return [tuple(r) for r in addq.search(df, **kw).select("query_id", "rank", "vec_id", "score").collect()]


def test_ranks_scores_and_ties(spark, monkeypatch):
    monkeypatch.setattr(addq, "PART_ROWS", (60, 60))
    rng = np.random.default_rng(1)
    rows = [(int(i), [float(x) for x in rng.integers(-3, 4, 6)]) for i in rng.permutation(200)]  # whole numbers: many exact ties
    rows += [rows[5], (20, [1.0] * 6), (20, [2.0, 0.0, 0.0, 0.0, 0.0, -1.0]), (40, [0.0] * 6), (60, None), (80, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (100, [float("nan")] * 6), (None, [1.0] * 6), (120, [1.0, 2.0]), (121, [2.0, 1.0])]
    got, want = _found(spark, rows, k=7, rerank=15), _plain(rows, 20, 7)
    by = lambda x: sorted((q, r, -s, v) for q, r, v, s in x)
    assert by(got) == by(want)
    each = defaultdict(int)
    for q, r, _, _ in got:
        each[q, r] += 1
    assert each[20, 1] == 3 and each[120, 1] == 2  # rows of a repeated id are ranked each on their own, by their own length


@pytest.mark.parametrize("spread", [0.05, 0.5])
def test_cells_are_skipped_exactly(spread):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 16))
    x = centres[rng.integers(0, 40, 4000)] + spread * rng.normal(size=(4000, 16))
    books = addq.fit_books(x[:1500], books=6, words=64).astype(np.float32)
    codes = addq.encode(x.astype(np.float32), books)
    approx = addq.decode(codes, books)
    left, norm = (np.sqrt((z.astype(np.float64) ** 2).sum(1)) for z in (x - approx, approx))
    part = addq.Part(books, np.arange(4000), np.arange(4000), left + addq.ROUNDING * (norm + left), x, codes)
    q = x[::100]
    tables, bounds = np.einsum("qd,bkd->qbk", q.astype(np.float32), books), part.bounds(q)
    looked = 0
    for n in range(len(q)):
        cell = np.repeat(np.arange(len(part.begin)), part.end - part.begin)
        scores = part.vecs @ q[n]
        assert (scores <= bounds[n][cell] + 1e-9).all()
        at, got, seen = part.nearest(q[n], tables[n], bounds[n], 100 * n, 20, 50)
        scores[part.rows == 100 * n] = -np.inf
        want = np.lexsort((part.ids, -(part.vecs * q[n]).sum(1) + np.where(part.rows == 100 * n, np.inf, 0)))[:20]
        assert part.ids[at].tolist() == part.ids[want].tolist() and np.allclose(got, np.sort(scores)[::-1][:20])
        looked += seen
    if spread < 0.1:
        assert looked < 0.4 * len(q) * 4000


@pytest.mark.parametrize("scale", [1.0, 1e-30, 1e30])
def test_queries_share_a_scan(monkeypatch, scale):
    """Queries of a part are answered together: none looks up the whole part by itself, and ranks and scores are those of brute force, whatever the vectors' size."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 16))
    x[::7] = x[3]  # many ties
    x *= scale
    books = addq.fit_books(x[:1000] / scale, books=6, words=64).astype(np.float32) * np.float32(scale)
    codes = addq.encode((x / scale).astype(np.float32), books / np.float32(scale))
    approx = addq.decode(codes, books)
    left, norm = (np.sqrt((z.astype(np.float64) ** 2).sum(1)) for z in (x - approx, approx))
    looked, plain = [], addq.Part.looked_up
    monkeypatch.setattr(addq.Part, "looked_up", lambda self, table, at: looked.append(len(at)) or plain(self, table, at))
    run = addq._scan(type("B", (), {"value": books}), 20, 50)
    own = np.arange(0, 3000, 50)
    slack = left + addq.ROUNDING * (norm + left)
    batches = []
    for kind, ids, v, c, s in ((0, np.arange(3000), x, codes, slack), (1, own, x[own], codes[own], slack[own])):
        vectors = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1) * 16, pa.int32()), pa.array(v.ravel()))
        batches.append(pa.record_batch([pa.array(np.zeros(len(ids), np.int32)), pa.array(np.full(len(ids), kind, np.int32)), pa.array(ids), vectors, pa.array(ids), pa.array([z.tobytes() for z in c], pa.binary()), pa.array(s)], ["part", "kind", "vec_id", "v", "row", "codes", "slack"]))
    got = pa.Table.from_batches(list(run(iter(batches)))).to_pydict()
    found = defaultdict(list)
    for q, i, s in zip(got["query"], got["vec_id"], got["score"], strict=True):
        found[q].append((i, s))
    for q in own.tolist():
        scores = (x * x[q]).sum(1)
        scores[q] = -np.inf
        want = np.lexsort((np.arange(3000), -scores))[:20]
        assert [i for i, _ in found[q]] == want.tolist() and [s for _, s in found[q]] == scores[want].tolist()
    assert sum(looked) < 0.5 * len(own) * 3000
