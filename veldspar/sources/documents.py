"""JSON documents as tables: benchmark manifests, run manifests, claim ledgers; bundles of artefacts with a checksummed manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldspar.functions.hashing import digest_files
from veldspar.operators.governance import manifest_integrity

FILE = "struct<relative_path:string,sha256:string,size_bytes:bigint,media_type:string,role:string>"
PRODUCT = f"struct<product_id:string,mission:string,payload_family:string,role:string,product_level:string,source_url:string,license:string,split_role:string,terrain_group:string,control_uncertainty_m:double,files:array<{FILE}>>"
MANIFEST = f"schema_version string, manifest_id string, interim boolean, created_utc timestamp, notes string, products array<{PRODUCT}>"
STAGE = "struct<stage_name:string,stage_version:string,outcome:string,fingerprint:string,published:boolean>"
RUN = f"run_id string, created_utc timestamp, updated_utc timestamp, seed bigint, parameters map<string,string>, inputs map<string,string>, stages array<{STAGE}>"
CLAIM = "struct<claim_id:string,run_report_id:string,checkpoint_id:string,value:double,unit:string,metric_reference:struct<scene_product_id:string,metric_key:string,value:double,unit:string>>"
LEDGER = f"schema_version string, claims array<{CLAIM}>"


def _documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A row per document; one that isn't JSON of the schema raises."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A row per product (ordinal from 0) with its manifest_id."""
    return _documents(spark, path, MANIFEST).select("manifest_id", F.posexplode("products").alias("ordinal", "p")).select("manifest_id", "ordinal", "p.*")


def manifest_files(products: DataFrame) -> DataFrame:
    """path, sha256, size of the files that a manifest's products list."""
    return products.select(F.explode("files").alias("f")).select(F.col("f.relative_path").alias("path"), F.col("f.sha256").alias("sha256"), F.col("f.size_bytes").alias("size"))


def read_run_manifest(spark: SparkSession, path: str) -> DataFrame:
    return _documents(spark, path, RUN)


def read_claim_ledger(spark: SparkSession, path: str) -> DataFrame:
    """A row per claim; an empty ledger has none."""
    rows = _documents(spark, path, LEDGER).select(F.explode("claims").alias("c")).select("c.*")
    ref = F.col("metric_reference")
    return rows.select("claim_id", F.col("run_report_id").alias("report_id"), "checkpoint_id", ref["scene_product_id"].alias("scene_product_id"), ref["metric_key"].alias("metric_key"), "value", "unit", ref["value"].alias("ref_value"), ref["unit"].alias("ref_unit"))


def write_bundle(tables: dict[str, DataFrame], path: str) -> DataFrame:
    """Writes each table under its name, once, then the manifest of all their files; without a manifest there is no bundle. Gives the manifest."""
    first = next(iter(tables.values()))
    for name, rows in tables.items():
        rows.write.mode("errorifexists").parquet(f"{path}/{name}")
    files = _files(first.sparkSession, path, list(tables))
    files.coalesce(1).write.mode("errorifexists").json(f"{path}/manifest")
    return first.sparkSession.read.schema("path string, size bigint, sha256 string").json(f"{path}/manifest")


def _files(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    out = None
    for name in names:
        rows = digest_files(spark, f"{path}/{name}").where("path NOT LIKE '%/\\\\_%'")
        below = F.substring_index("path", f"{path.rstrip('/').rsplit('/', 1)[-1]}/{name}/", -1)  # partitions may hold files of one name
        rows = rows.select(F.concat(F.lit(f"{name}/"), below).alias("path"), F.col("size_bytes").alias("size"), "sha256")
        out = rows if out is None else out.unionByName(rows)
    return out


def validate_bundle(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """path, status of every file that a bundle lists or holds under the names: checksums are tested before sizes."""
    manifest = spark.read.schema("path string, size bigint, sha256 string").json(f"{path}/manifest")
    return manifest_integrity(manifest, _files(spark, path, names), checksum_first=True)
