"""Intermediate tables in the shared folder, and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A side of a join is broadcast only when it was counted and has at most this many rows and bytes.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20

_own_dir: list[str] = []
#: The open recorders of this thread (or task) alone, outermost first.
_recorders: ContextVar[tuple[list[str], ...]] = ContextVar("recorders", default=())


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Only a local session may leave that unset; it gets a temporary folder."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own_dir:
        _own_dir.append("file://" + tempfile.mkdtemp(prefix="veldspar-"))
    return _own_dir[0]


def materialise(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    for made in _recorders.get():
        made.append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def recorded() -> Iterator[list[str]]:
    """Collects the paths of the tables that are materialised within the block."""
    made: list[str] = []
    mark = _recorders.set((*_recorders.get(), made))
    try:
        yield made
    finally:
        _recorders.reset(mark)


def drop_tables(spark: SparkSession, paths: list[str]) -> None:
    """Deletes tables that nothing reads any more; clears the list."""
    context = spark.sparkContext
    for path in paths:
        at = context._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)
    paths.clear()


def _width(field: T.StructField) -> Column:
    """About how many bytes a column's value takes."""
    c = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 8
    if isinstance(field.dataType, (T.ArrayType, T.MapType)):
        if isinstance(field.dataType, T.ArrayType) and not isinstance(field.dataType.elementType, (T.StringType, T.BinaryType, T.ArrayType, T.MapType, T.StructType)):
            return F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0)) * 8 + 8
        return F.coalesce(F.length(F.to_json(c) if not isinstance(field.dataType, T.ArrayType) else F.to_json(F.struct(c))), F.lit(0)) * 2 + 8
    return F.lit(8 if not isinstance(field.dataType, T.StructType) else 8 * len(field.dataType.fields))


def fits(right: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether a table has at most so many rows and bytes (counts no further than the limit)."""
    width = sum((_width(f).cast("long") for f in right.schema.fields), F.lit(0).cast("long"))
    n, total = right.select(width.alias("w")).limit(rows + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum("w"), F.lit(0))).first()
    return n <= rows and total <= size


def sized(right: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """right with a broadcast hint if a count proves it small; else with a hint for a shuffled join, whatever the planner's own estimate says."""
    return F.broadcast(right) if fits(right, rows, size) else right.hint("merge")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
