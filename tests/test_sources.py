"""Round trips of the record format."""

from __future__ import annotations

import pytest
from pyspark.sql import types as T

from veldspar.sources import correspondences as cs


def _rows(spark):
    schema = T._parse_datatype_string(cs.RECORD)
    full = {f.name: None for f in schema} | {
        "match_id": "a,b", "job_id": 'say "x"', "algorithm": "ncc", "selection_reason": "two\nlines", "pyramid_level": 2, "raw_score": 0.1 + 0.2,
        "source_pixel": (0.5, 1.25), "reference_pixel": (-1.0, 3e-9), "ground_coordinate": (1.0, None, "wkt"), "estimator_identities": ["ecc", "fourier"],
        "covariance_calibrated": False, "is_candidate": True, "is_inlier": False, "selected_for_coverage": False,
    }
    bare = {f.name: None for f in schema} | {"match_id": "é", "estimator_identities": []}
    return spark.createDataFrame([tuple(r[f.name] for f in schema) for r in (full, bare)], schema)


def test_csv_round_trip(spark, tmp_path):
    rows = _rows(spark)
    cs.write_csv(rows, f"{tmp_path}/out")
    got = cs.read_csv(spark, f"{tmp_path}/out")
    assert got.schema.simpleString() == rows.schema.simpleString()
    assert sorted(map(str, got.collect())) == sorted(map(str, rows.collect()))


def test_delimiter_in_identity_fails(spark, tmp_path):
    from pyspark.sql import functions as F

    with pytest.raises(Exception, match="estimator_identities"):
        cs.write_csv(_rows(spark).withColumn("estimator_identities", F.array(F.lit("a;b"))), f"{tmp_path}/bad")


def test_malformed_field_fails(spark):
    rows = cs.flattened(_rows(spark))
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        from pyspark.sql import functions as F

        cs.nested(rows.withColumn("raw_score", F.lit("much"))).collect()


def test_documents_and_bundles(spark, tmp_path):
    import json

    from veldspar.sources import documents

    (tmp_path / "m.json").write_text(json.dumps({"schema_version": "1", "manifest_id": "m1", "products": [{"product_id": "p", "role": "source", "split_role": "development", "files": [{"relative_path": "a.img", "sha256": "0" * 64, "size_bytes": 3}]}, {"product_id": "q", "role": "reference"}]}, indent=1))
    products = documents.read_manifest(spark, str(tmp_path / "m.json"))
    assert [(r["ordinal"], r["product_id"]) for r in products.orderBy("ordinal").collect()] == [(0, "p"), (1, "q")]
    assert [tuple(r) for r in documents.manifest_files(products).collect()] == [("a.img", "0" * 64, 3)]
    (tmp_path / "l.json").write_text('{"schema_version": "1", "claims": []}')
    assert documents.read_claim_ledger(spark, str(tmp_path / "l.json")).count() == 0
    (tmp_path / "bad.json").write_text("{nothing")
    with pytest.raises(Exception, match="(?i)malformed"):
        documents.read_run_manifest(spark, str(tmp_path / "bad.json")).collect()
    out = str(tmp_path / "bundle")
    made = documents.write_bundle({"points": spark.range(5), "masks": spark.range(2)}, out).collect()
    assert {r["path"].split("/")[0] for r in made} == {"points", "masks"}
    assert {r["status"] for r in documents.validate_bundle(spark, out, ["points", "masks"]).collect()} == {"ok"}
    hit = next(p for p in (tmp_path / "bundle" / "points").glob("*.parquet"))
    hit.write_bytes(hit.read_bytes() + b"x")
    for crc in (tmp_path / "bundle" / "points").glob(".*.crc"):
        crc.unlink()
    (tmp_path / "bundle" / "masks" / "new.parquet").write_bytes(b"y")
    assert {r["status"] for r in documents.validate_bundle(spark, out, ["points", "masks"]).collect()} == {"ok", "checksum_mismatch", "unknown"}
