"""Canonical JSON and digests as columns."""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _refuse(name: str):
    raise ValueError(name)


def canonical_json(document: Column, ascii_only: bool = False, drop_nulls: bool = False) -> Column:
    """JSON text with sorted keys and no blanks; null where the text isn't JSON or holds a number that isn't finite.

    Documents are digested as UTF-8; requests are escaped to ASCII and lose members that are null. Arrow batches of JSON text, a document at a time."""

    def without_nulls(x):
        if isinstance(x, dict):
            return {k: without_nulls(v) for k, v in x.items() if v is not None}
        return [without_nulls(v) for v in x] if isinstance(x, list) else x

    @F.arrow_udf("string")
    def canonical(texts: pa.Array) -> pa.Array:
        out = []
        for text in texts.to_pylist():
            try:
                value = json.loads(text, parse_constant=_refuse)
                value = without_nulls(value) if drop_nulls else value
                out.append(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=ascii_only, allow_nan=False))
            except (TypeError, ValueError):
                out.append(None)
        return pa.array(out, pa.string())

    return canonical(document)


def digest_json(document: Column, **how) -> Column:
    return F.sha2(canonical_json(document, **how).cast("binary"), 256)


def is_sha256(text: Column) -> Column:
    return F.coalesce(text.rlike("^[0-9a-f]{64}$"), F.lit(False))


def digest_many(rows: DataFrame, key: str, digest: str) -> DataFrame:
    """Digest of the digests of a group, whatever their order: that of the JSON array of the sorted digests. Null for a group that holds anything but digests.

    A digest of a whole group has to see all of it in order: 64 bytes a row in one task for each group."""
    sound = F.bool_and(is_sha256(F.col(digest)))
    text = F.concat(F.lit('["'), F.array_join(F.sort_array(F.collect_list(digest)), '","'), F.lit('"]'))
    return rows.groupBy(key).agg(F.when(sound, F.sha2(text.cast("binary"), 256)).alias("digest"))


def digest_files(spark, path: str) -> DataFrame:
    """path, size_bytes and sha256 of every file under a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"))


#: Names of members (letters and digits, joined by underscores) that may not come from outside, since they name places on the server.
PATH_KEYS = ("file_path", "filepath", "filesystem_path", "local_path", "path", "server_path", "source_path")


def server_paths(document: Column, names: tuple[str, ...] = PATH_KEYS) -> Column:
    """Sorted distinct places of a JSON document that name a place on the server: members by their name, and texts that are file URLs ("file://")."""

    @F.arrow_udf("array<string>")
    def found(texts: pa.Array) -> pa.Array:
        out = []
        for text in texts.to_pylist():
            hits, stack = set(), []
            try:
                stack.append(json.loads(text) if text is not None else None)
            except ValueError:
                pass
            while stack:
                x = stack.pop()
                if isinstance(x, dict):
                    plain = {k: re.sub("[^a-z0-9]+", "_", k.casefold()).strip("_") for k in x}
                    hits |= {p for p in plain.values() if p in names}
                    stack += x.values()
                elif isinstance(x, list):
                    stack += x
                elif isinstance(x, str) and x.casefold().startswith("file://"):
                    hits.add("file://")
            out.append(sorted(hits))
        return pa.array(out, pa.list_(pa.string()))

    return found(document)
