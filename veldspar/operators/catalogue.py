"""Catalogue queries: literal search, keyset pages, parent-scoped pages, activity union, nested detail."""

from __future__ import annotations

import base64
import json
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Least and greatest page size of the service.
MIN_LIMIT, MAX_LIMIT = 1, 100


def check_limit(limit: int) -> int:
    if not MIN_LIMIT <= limit <= MAX_LIMIT:
        raise ValueError(f"limit must lie in {MIN_LIMIT}..{MAX_LIMIT}")
    return limit


def encode_cursor(ts: datetime, id_: str) -> str:
    raw = json.dumps({"created_at": ts.isoformat(), "id": id_}, sort_keys=True, separators=(",", ":"))
    return base64.urlsafe_b64encode(raw.encode()).decode().rstrip("=")


def decode_cursor(cursor: str) -> tuple[datetime, str]:
    doc = json.loads(base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)))
    ts = datetime.fromisoformat(doc["created_at"])
    if ts.tzinfo is None:
        raise ValueError("a cursor's time needs a zone")
    return ts, doc["id"]


def literal_search(needle: str | None, columns: list[str]) -> Column:
    """Case-folded substring of any column; nothing in the needle is a wildcard. A missing needle matches all."""
    if not needle:
        return F.lit(True)
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.contains(F.lower(F.col(c).cast("string")), F.lit(needle.casefold())), F.lit(False))
    return hit


def keyset_page(rows: DataFrame, ts: str, id_: str, limit: int, cursor: tuple | None = None, overflow: bool = True) -> DataFrame:
    """Newest first by (ts, id), strictly after the cursor; one row more than the limit tells that another page follows."""
    if cursor is not None:
        at, last = F.lit(cursor[0]).cast("timestamp"), F.lit(cursor[1])
        rows = rows.where((F.col(ts) < at) | ((F.col(ts) == at) & (F.col(id_) < last)))
    return rows.orderBy(F.desc(ts), F.desc(id_)).limit(check_limit(limit) + overflow)


def child_page(rows: DataFrame, parents: DataFrame, parent_key: str, parent_id, ts: str, id_: str, limit: int, cursor: tuple | None = None) -> DataFrame:
    """The page of one parent's child rows; a parent that doesn't exist raises (parents: a column id)."""
    if parents.where(F.col("id") == F.lit(parent_id)).isEmpty():
        raise LookupError(f"no parent {parent_id!r}")
    return keyset_page(rows.where(F.col(parent_key) == F.lit(parent_id)), ts, id_, limit, cursor)


def records_for(rows: DataFrame, key: str, keys: DataFrame, ts: str, id_: str, limit: int) -> DataFrame:
    """Newest rows whose key is among keys (a semi-join); `truncated` says that there were more than limit. One row more than the limit is read, once."""
    page = rows.join(keys, key, "left_semi").orderBy(F.desc(ts), F.desc(id_)).limit(limit + 1)
    every = Window.partitionBy(F.lit(1))  # of at most limit + 1 rows
    page = page.withColumn("truncated", F.count(F.lit(1)).over(every) > limit).withColumn("_n", F.row_number().over(every.orderBy(F.desc(ts), F.desc(id_))))
    return page.where(F.col("_n") <= limit).drop("_n")


def polygon_geojson(ring: Column) -> Column:
    """GeoJSON text of a ring (array of structs lon, lat); null for a null ring."""
    line = F.transform(ring, lambda p: F.array(p["lon"], p["lat"]))
    return F.when(ring.isNotNull(), F.to_json(F.struct(F.lit("Polygon").alias("type"), F.array(line).alias("coordinates"))))


def point_geojson(lon: Column, lat: Column) -> Column:
    return F.when(lon.isNotNull() & lat.isNotNull(), F.to_json(F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates"))))


def _finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def polygon_of(geojson: Column) -> Column:
    """Struct of ring (array of structs lon, lat) and error: one outer ring of four or more finite positions of two numbers, the last equal to the first."""
    doc = F.from_json(geojson, "type string, coordinates array<array<array<double>>>", {"mode": "PERMISSIVE"})
    ring = F.get(doc["coordinates"], 0)
    error = (
        F.when(doc.isNull() | ~F.coalesce(doc["type"] == "Polygon", F.lit(False)), "not_a_polygon")
        .when(F.coalesce(F.size(doc["coordinates"]), F.lit(0)) != 1, "one_ring_expected")
        .when(F.coalesce(F.size(ring), F.lit(0)) < 4, "too_few_positions")
        .when(~F.forall(ring, lambda p: F.coalesce((F.size(p) == 2) & _finite(F.get(p, 0)) & _finite(F.get(p, 1)), F.lit(False))), "bad_position")
        .when(F.element_at(ring, 1) != F.element_at(ring, -1), "ring_not_closed")
    )
    return F.struct(F.when(error.isNull(), F.transform(ring, lambda p: F.struct(F.get(p, 0).alias("lon"), F.get(p, 1).alias("lat")))).alias("ring"), error.alias("error"))


def point_of(geojson: Column) -> Column:
    """Struct of lon, lat and error."""
    doc = F.from_json(geojson, "type string, coordinates array<double>", {"mode": "PERMISSIVE"})
    at = doc["coordinates"]
    error = F.when(doc.isNull() | ~F.coalesce(doc["type"] == "Point", F.lit(False)), "not_a_point").when(~F.coalesce((F.size(at) == 2) & _finite(F.get(at, 0)) & _finite(F.get(at, 1)), F.lit(False)), "bad_position")
    return F.struct(F.when(error.isNull(), F.get(at, 0)).alias("lon"), F.when(error.isNull(), F.get(at, 1)).alias("lat"), error.alias("error"))


def run_documents(runs: DataFrame) -> DataFrame:
    """Runs as the service shows them; a run recorded before manifests of parameters were kept says so."""
    return runs.withColumn("parameter_manifest_available", F.col("parameter_manifest").isNotNull())


def activity(sources: dict[str, DataFrame], limit: int | None = None) -> DataFrame:
    """Union of activity rows (run_id, recorded_at, kind, ...), newest first; at most limit rows of each run and source."""
    out = None
    for kind, rows in sources.items():
        rows = rows.withColumn("kind", F.lit(kind))
        if limit is not None:
            w = Window.partitionBy("run_id").orderBy(F.desc("recorded_at"), F.desc("id"))
            rows = rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= limit).drop("_n")
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


def nested_children(parents: DataFrame, key: str, children: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """Each parent with its child rows as sorted arrays of structs."""
    for name, (rows, columns) in children.items():
        rows = rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*columns))).alias(name))
        parents = parents.join(rows, key, "left")
    return parents
