"""Tie-point records as CSV: one column per leaf of the nested record, in the record's order; empty fields are null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_PIXEL, _SHIFT = "struct<line:double,sample:double>", "struct<dy:double,dx:double>"
#: Fields of the CSV format, in its order; a nested field is a column parent.field.
RECORD = f"""match_id string, job_id string, algorithm string, algorithm_version string, tile_id string, pyramid_level int, selection_reason string,
    source_pixel {_PIXEL}, reference_pixel {_PIXEL}, ground_coordinate struct<x_m:double,y_m:double,crs_wkt:string>,
    raw_score double, calibrated_confidence double, descriptor_channel_agreement double, forward_backward_error_px double,
    prior_displacement_px {_SHIFT}, residual_from_prior_px {_SHIFT}, robust_model_residual_px double,
    local_warp_jacobian struct<d_ref_line_d_src_line:double,d_ref_line_d_src_sample:double,d_ref_sample_d_src_line:double,d_ref_sample_d_src_sample:double>,
    coarse_location {_PIXEL}, refined_location {_PIXEL}, estimator_identities array<string>, estimator_disagreement_px double,
    covariance struct<xx:double,xy:double,yy:double,frame:string,units:string>, covariance_method string, covariance_calibrated boolean,
    is_candidate boolean, is_inlier boolean, point_role string, rejection_reason string, nms_status string, eligible_cell_id string,
    grid_level int, selected_for_coverage boolean, coverage_selection_rationale string,
    input_digest string, reference_digest string, parameter_set_digest string, code_revision string"""
JOINED_BY = ";"


def _leaves(schema: T.StructType) -> list[tuple[str, T.DataType]]:
    out: list[tuple[str, T.DataType]] = []
    for f in schema:
        out += [(f"{f.name}.{g.name}", g.dataType) for g in f.dataType] if isinstance(f.dataType, T.StructType) else [(f.name, f.dataType)]
    return out


def _joined(name: str) -> Column:
    """An array of strings in one field; an element that holds the delimiter fails the write."""
    clash = F.exists(name, lambda x: x.contains(JOINED_BY))
    return F.when(clash, F.raise_error(F.concat(F.lit(f"{name} holds {JOINED_BY!r}: "), F.array_join(name, " ")))).otherwise(F.array_join(name, JOINED_BY))


def flattened(records: DataFrame, record: str = RECORD) -> DataFrame:
    """A string column per leaf, in the format's order; columns beyond the record's are left out."""
    cols = []
    for name, kind in _leaves(T._parse_datatype_string(record)):
        value = _joined(name) if isinstance(kind, T.ArrayType) else F.col(name).cast("string")
        cols.append(value.alias(name))
    return records.select(*cols)


def nested(rows: DataFrame, record: str = RECORD) -> DataFrame:
    """The records of flattened rows, strictly: a field that its type can't hold fails. A struct is null where all its fields are empty."""
    leaf = lambda name, kind: F.when(F.col(f"`{name}`") != "", F.col(f"`{name}`")).cast(kind)
    cols = []
    for f in T._parse_datatype_string(record):
        if isinstance(f.dataType, T.StructType):
            parts = [leaf(f"{f.name}.{g.name}", g.dataType).alias(g.name) for g in f.dataType]
            cols.append(F.when(F.coalesce(*[p.cast("string") for p in parts]).isNotNull(), F.struct(*parts)).alias(f.name))
        elif isinstance(f.dataType, T.ArrayType):
            text = F.coalesce(F.col(f"`{f.name}`"), F.lit(""))
            cols.append(F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, JOINED_BY)).alias(f.name))
        else:
            cols.append(leaf(f.name, f.dataType).alias(f.name))
    return rows.select(*cols)


def write_csv(records: DataFrame, path: str, record: str = RECORD) -> None:
    """A folder of CSV files with headers; it must not exist. Quotes are doubled and line ends kept inside quotes."""
    flattened(records, record).write.option("header", True).option("escape", '"').option("emptyValue", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def read_csv(spark: SparkSession, path: str, record: str = RECORD) -> DataFrame:
    names = T.StructType([T.StructField(n, T.StringType()) for n, _ in _leaves(T._parse_datatype_string(record))])
    rows = spark.read.schema(names).option("header", True).option("enforceSchema", False).option("escape", '"').option("multiLine", True).option("mode", "FAILFAST").csv(path)
    return nested(rows, record)
