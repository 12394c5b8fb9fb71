"""Queries of the engine against their SQL on the smallest tables, and semantics that the tables don't show."""

from __future__ import annotations

import math

import duckdb
import pytest

from veldspar.operators import catalogue, tiepoints
from veldspar.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def _norm(v):
    return ("nan" if math.isnan(v) else round(v, 6) + 0.0) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_sql(spark, con, name):
    df = registry.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(_norm(r[c]) for c in cols) for r in df.collect()), key=str)
    res = con.execute(registry.ORACLES[name])
    names = [c[0] for c in res.description]
    want = sorted((tuple(_norm(dict(zip(names, r, strict=True))[c]) for c in cols) for r in res.fetchall()), key=str)
    assert sorted(names) == cols and got == want


def test_cursor_round_trip():
    from datetime import datetime, timezone

    at = (datetime(2024, 1, 2, 3, 4, 5, 6, tzinfo=timezone.utc), "abc")
    assert catalogue.decode_cursor(catalogue.encode_cursor(*at)) == at
    with pytest.raises(ValueError):
        catalogue.check_limit(101)


def test_greedy_suppression(spark):
    rows = spark.createDataFrame([(1, "a", 0.0, 0.0, 3.0), (1, "b", 0.0, 5.0, 2.0), (1, "c", 0.0, 10.0, 1.0), (2, "d", 0.0, 0.0, 1.0)], "job_id int, match_id string, line double, sample double, score double")
    got = {r["match_id"]: r["nms_status"] for r in tiepoints.suppress_non_maxima(rows, 6.0).collect()}
    assert got == {"a": "survived", "b": "suppressed", "c": "survived", "d": "survived"}


def test_affine_is_recovered(spark):
    pts = [(1, f"m{i}", float(i % 7), float(i * i % 11)) for i in range(20)]
    rows = spark.createDataFrame([(j, m, x, y, 2 * x - y + 3, x + 0.5 * y - 1) for j, m, x, y in pts], "job_id int, match_id string, line double, sample double, ref_line double, ref_sample double")
    fit = tiepoints.affine_normal_fit(rows, ["job_id"]).first()
    assert [round(fit[k], 6) for k in ("u_line", "u_sample", "u_shift", "v_line", "v_sample", "v_shift")] == [2, -1, 3, 1, 0.5, -1]
