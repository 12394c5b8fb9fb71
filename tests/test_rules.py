"""Values worked out by hand from the rules."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from veldspar.functions import geometry as geo
from veldspar.functions import hashing
from veldspar.operators import components, coverage, gates, governance, raster, routes, tiepoints


def test_covariance_tolerances(spark):
    rows = spark.createDataFrame([(1, 2.0, 2.0 + 1.5e-5), (2, 2.0, 2.0 + 2.5e-5), (3, 0.0, 9e-9), (4, 0.0, 2e-8)], "id int, b double, c double")
    got = rows.select("id", geo.hessian_covariance(F.lit(9.0), F.col("b"), F.col("c"), F.lit(8.0), F.lit(1.0), 1e8).isNotNull().alias("ok")).collect()
    assert {r["id"]: r["ok"] for r in got} == {1: True, 2: False, 3: True, 4: False}


def test_projection_choice(spark):
    cases = {(70.0, 80.0): ("north_polar_stereographic", None), (-80.0, -10.0): ("south_polar_stereographic", None), (-74.9, 74.9): ("equirectangular", None), (-80.0, 80.0): (None, "spans_both_caps"), (-1.0, 75.0): (None, "north_crosses_equator"), (-75.0, 1.0): (None, "south_crosses_equator"), (5.0, 4.0): (None, "bounds_not_ordered")}
    rows = spark.createDataFrame(list(cases), "low double, high double").select("low", "high", geo.select_crs(F.col("low"), F.col("high")).alias("c")).collect()
    assert {(r["low"], r["high"]): (r["c"]["projection"], r["c"]["error"]) for r in rows} == cases


def test_digest_of_digests(spark):
    a, b = "0" * 64, "f" * 64
    rows = spark.createDataFrame([(1, b), (1, a), (2, a), (2, "none")], "k int, d string")
    want = hashlib.sha256(f'["{a}","{b}"]'.encode()).hexdigest()
    assert {r["k"]: r["digest"] for r in hashing.digest_many(rows, "k", "d").collect()} == {1: want, 2: None}
    docs = spark.createDataFrame([('{"b": 1, "a": "é", "c": null}',), ('{"a": NaN}',), ("no json",), (None,)], "d string")
    got = [tuple(r) for r in docs.select(hashing.canonical_json(F.col("d")), hashing.canonical_json(F.col("d"), True, True)).collect()]
    assert got[0] == ('{"a":"é","b":1,"c":null}', '{"a":"\\u00e9","b":1}') and got[1:] == [(None, None)] * 3


def test_duplicates_in_a_long_chain(spark):
    rows = spark.createDataFrame([(1, f"m{i:03}", float(i), 0.0, float(i % 7)) for i in range(200)] + [(1, "far", 500.0, 0.0, 0.0)], "job_id int, match_id string, line double, sample double, score double")
    assert {r["match_id"] for r in tiepoints.remove_duplicates(rows, 1.0).collect()} == {"m006", "far"}
    with pytest.raises(RuntimeError):
        components.components(spark.createDataFrame([(i, i + 1) for i in range(50)], "u long, v long"), rounds=1)


def test_greedy_suppression_against_a_plain_pass(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i % 3), f"m{i:03}", float(rng.integers(0, 30)), float(rng.integers(0, 30)), float(rng.integers(0, 5))) for i in range(150)]
    got = {r["match_id"]: r["nms_status"] for r in tiepoints.suppress_non_maxima(spark.createDataFrame(rows, "job_id int, match_id string, line double, sample double, score double"), 5.0).collect()}
    alive: list = []
    for j, m, x, y, s in sorted(rows, key=lambda r: (-r[4], r[1])):
        ok = all(j != k or math.hypot(x - a, y - b) > 5 for k, a, b in alive)
        alive += [(j, x, y)] if ok else []
        assert got[m] == ("survived" if ok else "suppressed")


def _affine_points(n=10):
    c, s = math.cos(0.1), math.sin(0.1)
    pts = [(float(10 * i % 37), float(17 * i % 53)) for i in range(n)]
    return [(1, f"m{i}", x, y, c * x - s * y + 5, s * x + c * y - 3, 1.0, i) for i, (x, y) in enumerate(pts)]


_SCHEMA = "job_id int, match_id string, line double, sample double, ref_line double, ref_sample double, score double, ord int"


@pytest.mark.parametrize("seed", [None, 11])
def test_robust_affine(spark, seed):
    rows = _affine_points() + [(1, "out1", 5.0, 5.0, 90.0, 90.0, 1.0, 20), (1, "out2", 9.0, 2.0, -50.0, 7.0, 1.0, 21), (2, "a", 0.0, 0.0, 0.0, 0.0, 1.0, 0), (2, "b", 1.0, 0.0, 0.0, 0.0, 1.0, 1), (3, "p", 0.0, 0.0, 0.0, 0.0, 1.0, 0), (3, "q", 1.0, 1.0, 1.0, 1.0, 1.0, 1), (3, "r", 2.0, 2.0, 2.0, 2.0, 1.0, 2)]
    got = {r["match_id"]: r for r in tiepoints.robust_affine(spark.createDataFrame(rows, _SCHEMA), 2.0, seed=seed).collect()}
    assert all(got[f"m{i}"]["is_inlier"] and got[f"m{i}"]["residual_px"] < 1e-6 for i in range(10))
    assert abs(got["m0"]["u_line"] - math.cos(0.1)) < 1e-9 and abs(got["m0"]["v_shift"] + 3) < 1e-9
    assert not got["out1"]["is_inlier"] and got["out1"]["rejection_reason"].endswith("exceeds residual_threshold_px=2.0000")
    assert "fewer than three" in got["a"]["rejection_reason"] and "insufficient" in got["p"]["rejection_reason"] and got["a"]["residual_px"] is None


def test_first_triples_against_a_plain_version(spark):
    from itertools import combinations, islice

    rng = np.random.default_rng(8)
    rows = []
    for job in range(4):
        n = int(rng.integers(3, 14))
        for i in range(n):
            x, y = rng.uniform(0, 100, 2).tolist()
            off = (rng.uniform(-20, 20, 2) if rng.random() < 0.4 else rng.uniform(-0.4, 0.4, 2)).tolist()
            rows.append((job, f"m{i:02}", x, y, 1.01 * x + 0.02 * y + 3 + off[0], -0.03 * x + 0.98 * y - 2 + off[1], 1.0, i))
    got = {(r["job_id"], r["match_id"]): r for r in tiepoints.robust_affine(spark.createDataFrame(rows, _SCHEMA), 1.5, trials=20).collect()}
    for job in range(4):
        own = [r for r in rows if r[0] == job]
        a, b = np.array([[r[2], r[3], 1.0] for r in own]), np.array([r[4:6] for r in own])
        best = None
        for three in islice(combinations(range(len(own)), 3), 20):
            r = np.hypot(*(b - a @ np.linalg.solve(a[list(three)], b[list(three)])).T)
            key = (-int((r <= 1.5).sum()), float(r[r <= 1.5].sum()))
            best = min(best or (key, r <= 1.5), (key, r <= 1.5), key=lambda k: k[0])
        fit = np.linalg.lstsq(a[best[1]], b[best[1]], rcond=None)[0]
        r = np.hypot(*(b - a @ fit).T)
        for k, row in enumerate(own):
            assert abs(got[job, row[1]]["residual_px"] - r[k]) < 1e-6 and got[job, row[1]]["is_inlier"] == (r[k] <= 1.5)


def test_coverage_and_evidence(spark):
    # a 2 x 2 grid of 10 x 10 cells, one of them not eligible; the selected points span a triangle of 8 * 8 / 2
    grid = spark.createDataFrame([(0, 0, True), (0, 1, True), (1, 0, True), (1, 1, False)], "row int, col int, eligible boolean")
    points = [(1, 1.0, 1.0, True, True), (1, 9.0, 1.0, True, True), (1, 1.0, 9.0, True, True), (1, 15.0, 15.0, True, False), (1, 2.0, 12.0, False, False), (2, 1.0, 12.0, True, False)]
    rows = spark.createDataFrame(points, "job_id int, line double, sample double, is_inlier boolean, selected boolean")
    got = {r["job_id"]: r for r in coverage.coverage_metrics(rows, grid, 20, 20, 2).collect()}
    assert (got[1]["occupancy"], got[1]["hull_ratio"], got[1]["largest_empty_run"]) == (1 / 3, 32 / 300, 1)
    assert (got[2]["occupancy"], got[2]["hull_ratio"], got[2]["largest_empty_run"], got[2]["eligible_cells"]) == (0.0, None, 3, 3)
    assert {(r["row"], r["col"], r["n"]) for r in coverage.cell_counts(rows, 20, 20, 2).where("job_id = 1").collect()} == {(0, 0, 3), (1, 1, 1)}
    ev = spark.createDataFrame([(1, True, True, "withheld_check_point", 0.5, True, False, 3.0), (1, True, False, "withheld_check_point", None, False, False, 4.0), (2, False, False, "fitting_inlier", None, True, True, 1.0)], "job_id int, is_candidate boolean, is_inlier boolean, point_role string, estimator_disagreement_px double, has_covariance boolean, covariance_calibrated boolean, residual_px double")
    out = {r["job_id"]: r for r in gates.scene_evidence(ev, coverage.coverage_metrics(rows, grid, 20, 20, 2), 4).collect()}
    assert (out[1]["verified_inlier_fraction"], out[1]["uncalibrated_covariance_fraction"], out[1]["invalid_covariance_fraction"], out[1]["max_estimator_disagreement_px"]) == (0.5, 1.0, 0.0, 0.5)
    assert out[1]["withheld_rmse_2d_px"] == math.sqrt(12.5) and out[1]["largest_empty_run_fraction"] == 0.25
    assert out[2]["verified_inlier_fraction"] is None and out[2]["withheld_rmse_2d_px"] is None and out[2]["eligible_occupancy"] == 0.0


def test_stencils(spark):
    image = [(1, i, j, v, True) for i, row in enumerate([[0, 1, 0], [2, 4, 6], [0, 3, 0]]) for j, v in enumerate(map(float, row))]
    p = spark.createDataFrame(image, "image_id int, line int, sample int, value double, valid boolean")
    at = "line = 1 AND sample = 1"
    g, f = raster.gradients(p).where(at).first(), raster.phase_equivalent(p).where(at).first()
    # axial differences 3, 1, 2, 2: their 95th percentile is 2 + 0.85; the gradient is (2, 1)
    assert abs(g["magnitude"] - math.hypot(2, 1) / 2.85) < 1e-12 and abs(g["orientation"] - math.atan2(1, 2)) < 1e-12
    assert abs(f["phase"] - 4 / 8) < 1e-12
    flat = p.withColumn("value", F.lit(2.0))
    assert raster.gradients(flat).where(at).first()["magnitude"] == 0.0 and raster.gradients(flat).where(at).first()["orientation"] is None and raster.phase_equivalent(flat).where(at).first()["phase"] == 0.0


def test_quantiles_of_ties_and_spread(spark):
    rng = np.random.default_rng(2)
    groups = {1: rng.normal(size=500), 2: np.array([3.0] * 40), 3: np.array([1.0]), 4: np.concatenate([[0.0] * 90, rng.uniform(0, 1e9, 10)])}
    rows = spark.createDataFrame([(k, float(v)) for k, vs in groups.items() for v in vs] + [(1, None)], "k int, v double")
    got = {r["k"]: r for r in raster.quantiles(rows, ["k"], "v", {"a": 0.05, "b": 0.5, "c": 0.93}, bins=8).collect()}
    for k, vs in groups.items():
        assert np.allclose([got[k][c] for c in "abc"], np.quantile(vs, [0.05, 0.5, 0.93]))


def test_overlap_of_outlines(spark):
    ring = lambda pts: [{"x": float(x), "y": float(y)} for x, y in pts]
    square = ring([(0, 0), (2, 0), (2, 2), (0, 2)])
    cases = [(square, square, 1.0), (square, ring([(1, 1), (3, 1), (3, 3), (1, 3)]), 0.25), (square, ring([(5, 5), (6, 5), (6, 6)]), 0.0), (square, ring([(-1, -1), (4, -1), (4, 4), (-1, 4)]), 1.0), (ring([(0, 0), (2, 2), (4, 4)]), square, 0.0)]
    rows = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], "i int, a array<struct<x:double,y:double>>, b array<struct<x:double,y:double>>")
    got = {r["i"]: r["s"] for r in rows.select("i", routes.overlap_share(F.col("a"), F.col("b")).alias("s")).collect()}
    assert all(abs(got[i] - want) < 1e-9 for i, (_, _, want) in enumerate(cases))


def test_unsafe_paths_and_published_files(spark, tmp_path):
    m = spark.createDataFrame([("a", "x", 1), ("../b", "x", 1), ("/c", "x", 1)], "path string, sha256 string, size int")
    assert {r["path"]: r["status"] for r in governance.manifest_integrity(m, m.where("path = 'a'")).collect()} == {"a": "ok", "../b": "unsafe_path", "/c": "unsafe_path"}
    out = str(tmp_path / "artefact")
    files = governance.publish(spark.range(3), out).collect()
    assert files and all(len(r["sha256"]) == 64 and r["size_bytes"] > 0 for r in files if r["uri"].endswith(".parquet"))
    with pytest.raises(Exception, match="(?i)exists"):
        governance.publish(spark.range(3), out)


def test_self_similarity_against_a_plain_version(spark):
    rng = np.random.default_rng(4)
    v, ok = rng.normal(size=(13, 12)), np.ones((13, 12), bool)
    ok[0, 0] = False
    rows = spark.createDataFrame([(1, i, j, float(v[i, j]), bool(ok[i, j])) for i in range(13) for j in range(12)], "image_id int, line int, sample int, value double, valid boolean")
    got = {(r["line"], r["sample"]): r["self_similarity"] for r in raster.self_similarity(rows).collect()}
    offsets = [(i, j) for i in range(-3, 4) for j in range(-3, 4) if max(abs(i), abs(j)) > 2]
    patch = lambda i, j: v[i - 1 : i + 2, j - 1 : j + 2]
    for (i, j), s in got.items():
        inside = 4 <= i < 9 and 4 <= j < 8
        if not inside or not ok[i - 4 : i + 5, j - 4 : j + 5].all():
            assert s is None
            continue
        own = patch(i, j)
        want = max(math.exp(-((own - patch(i + a, j + b)) ** 2).mean() / max(own.var(), 1e-12)) for a, b in offsets)
        assert abs(s - want) < 1e-9


def test_terrain_of_many_sites_against_a_search(spark):
    """Assets of any length, beyond the poles and of equal bounds, against every pair; no pair is met that the cells settle."""
    rng = np.random.default_rng(5)
    kinds = ["sldem2015", "polar_dem", "lola", "image"]
    assets = []
    for i in range(600):
        low = float(rng.choice([rng.uniform(-95, 90), rng.integers(-90, 90)]))
        assets.append((int(rng.integers(3)), i, f"a{i}", kinds[rng.integers(4)], "terrain" if rng.integers(4) else "control", low, low + float(rng.choice([0.0, 0.05, rng.uniform(0, 150)]))))
    sites = [(i, int(rng.integers(4)), float(rng.choice([rng.uniform(-90, 90), rng.integers(-90, 91)]))) for i in range(500)] + [(500, 1, None), (501, 1, 90.0), (502, 2, -90.0)]
    tables = spark.createDataFrame(sites, "site long, bundle_id int, latitude double"), spark.createDataFrame(assets, "bundle_id int, ordinal int, identifier string, kind string, role string, lat_low double, lat_high double")
    got = {r["site"]: r["identifier"] for r in routes.terrain_references(*tables).collect()}
    for site, bundle, lat in sites:
        fit = [(kinds.index(k), n, name) for b, n, name, k, role, lo, hi in assets if lat is not None and b == bundle and role == "terrain" and lo <= lat <= hi and (k in kinds[1:3] or (k == "sldem2015" and abs(lat) <= 60))]
        assert got[site] == (min(fit)[2] if fit else None)
    assert len(got) == len(sites)


def test_inputs_of_fits(spark):
    """Repeated inputs, roles against the manifest, products listed twice or not at all; no last pass over all rows."""
    inputs = spark.createDataFrame([(1, 1, "development"), (1, 1, "validation"), (1, 2, "development"), (1, 3, "held_out_test"), (1, 4, "validation"), (2, 5, "development"), (2, 6, None)], "fit_id long, product_id long, split_role string")
    products = spark.createDataFrame([(1, "development"), (2, "development"), (2, "validation"), (3, "held_out_test"), (4, "development"), (6, None)], "product_id long, split_role string")
    rows = governance.fit_violations(inputs, products)
    want = [(1, 1, "repeated_input"), (1, 2, "role_differs_from_manifest"), (1, 3, "split_not_for_fitting"), (1, 4, "role_differs_from_manifest"), (2, 5, "role_differs_from_manifest"), (2, 6, "role_differs_from_manifest")]
    assert sorted(tuple(r) for r in rows.collect()) == want
    assert "Window" not in rows._jdf.queryExecution().executedPlan().toString()


def test_scores_of_images_leave_pixels_where_they_are(spark):
    pixels = spark.createDataFrame([(i, y, x, float(y * x % 7 + i), (y + x) % 5 > 0) for i in (1, 2) for y in range(6) for x in range(6)], "image_id long, line long, sample long, value double, valid boolean")
    rows = raster.z_score(pixels, "value", F.col("valid"), "z")
    assert "SortMergeJoin" not in rows._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0] and "BroadcastHashJoin" in rows._jdf.queryExecution().executedPlan().toString()
    for i in (1, 2):
        own = [r["z"] for r in rows.where(f"image_id = {i} and valid").collect()]
        assert abs(sum(own)) < 1e-9 and abs(sum(v * v for v in own) / len(own) - 1) < 1e-9


def test_overlap_reckons_its_areas_once(spark):
    """The plan of an overlap of given outlines names each of them a few times, not once for every use of an area."""
    box = "array(named_struct('x', 0D, 'y', 0D), named_struct('x', 4D, 'y', 0D), named_struct('x', 4D, 'y', 4D), named_struct('x', 0D, 'y', 4D))"
    df = spark.sql(f"SELECT {box} AS a, transform({box}, p -> named_struct('x', p.x + 1D, 'y', p.y + s)) AS b FROM VALUES (1D), (5D) AS t(s)")
    rows = df.select(routes.overlap_share(F.col("a"), F.col("b")).alias("share"))
    assert [r["share"] for r in rows.collect()] == [0.5625, 0.0]
    assert str(routes.overlap_share(F.col("a"), F.col("b"))).count("signum") <= 2
