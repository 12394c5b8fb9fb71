"""SimHash near-dedup by segment-popcount embedding (operator 11).

A text's fingerprint has a bit for each of the 64 of its shingles' hashes that is set in over half of them. Texts of equal fingerprint are one
class. A fingerprint is embedded as the number of bits in each of 16 segments of four; one flipped bit moves one count by one, so that the Manhattan
distance of two such points is at most the number of differing bits. Points within distance two share a cell of the unit grid that is
within distance one of both: every class goes to its own cell and the 32 around it, and the classes that meet in a cell are compared bit by bit.

A cell of more than CROWD classes is not paired. Its members go to the finest grid instead, of segments of one bit, where the embedding is the
fingerprint itself: a cell there is a fingerprint, it holds at most 65 classes, and all of them differ from each other by two bits at most, so that each is
linked with the least. A pair whose shared cells are all crowded is found there, any other in a cell that isn't: no link is lost, no
cell is paired beyond CROWD members, and links stay in proportion to the classes.

Defined results: null, empty and wordless texts have fingerprint zero and link like any other; fewer words than a shingle are one shingle; repeated
rows and equal texts share a component; a null doc_id is never a component's number unless no other document is reached; empty tables give
empty results. Texts of any length are read in pieces. Columns other than doc_id and text are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veldspar.llm.common import drop_tables, materialise, recorded, sized
from veldspar.operators.components import components

WIDTH, RADIUS = 3, 2
#: The seed of a shingle's XXH64.
SEED = 42
#: Segments of the embedding, and their bits.
SEGMENTS, SEGMENT_BITS = 16, 4
#: Classes that a cell of the embedding's grid pairs at most; beyond that its members go to the finest grid.
CROWD = 64
#: Bytes of a text that are split into words at a time.
PIECE = 1 << 20


def _pieces(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, A-Z lower-cased, piece by piece (bytes.split() parts at the blanks 0x20 and 0x09 to 0x0D)."""
    rest = b""
    for at in range(0, len(text), PIECE):
        piece = rest + text[at : at + PIECE].lower()
        words = piece.split()
        rest = b""
        if at + PIECE < len(text) and words and not piece[-1:].isspace():
            rest = words.pop()  # may go on in the next piece
        yield words
    if rest:
        yield [rest]


def _bit_counts(shingles: Iterator[bytes]) -> tuple[int, np.ndarray]:
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64)
    return len(hashes), np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)


def fingerprint(text: bytes, width: int = WIDTH) -> int:
    """64 bits: each is 1 if it is set in the hashes of over half the shingles, repeats counted."""
    n, ones, held = 0, np.zeros(64, np.int64), []
    for words in _pieces(text):
        held += words
        if len(held) >= width:
            k, found = _bit_counts(map(b" ".join, zip(*(held[i:] for i in range(width)), strict=False)))
            n, ones, held = n + k, ones + found, held[len(held) - width + 1 :]
    if n == 0 and held:
        n, ones = _bit_counts(iter([b" ".join(held)]))
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = np.fromiter((fingerprint(t.as_py() or b"", width) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.record_batch([b.column(0), pa.array(out.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, fp long")


def embedded(fp: Column) -> Column:
    """The counts of set bits of the segments, packed into one long of four bits a segment."""
    one = lambda i: F.shiftleft(F.bit_count(F.shiftrightunsigned(fp, SEGMENT_BITS * i).bitwiseAND(F.lit(15))).cast("long"), SEGMENT_BITS * i)
    return reduce(Column.bitwiseOR, map(one, range(SEGMENTS)))


def cells(classes: DataFrame) -> DataFrame:
    """fp, side (0 for the own cell, else which neighbour), cell: the grid cells within Manhattan distance one of each class."""

    def step(i: int, by: int) -> Column:
        count = F.shiftrightunsigned("point", SEGMENT_BITS * i).bitwiseAND(F.lit(15))
        inside = count < SEGMENT_BITS if by > 0 else count > 0
        return F.when(inside, F.struct(F.lit(by * (i + 1)).cast("byte").alias("side"), (F.col("point") + F.lit(by << (SEGMENT_BITS * i))).alias("cell")))

    near = [F.struct(F.lit(0).cast("byte").alias("side"), F.col("point").alias("cell")), *(step(i, by) for i in range(SEGMENTS) for by in (1, -1))]
    rows = classes.select("fp", embedded(F.col("fp")).alias("point")).select("fp", F.explode(F.array(*near)).alias("c"))
    return rows.where("c is not null").select("fp", "c.side", "c.cell")


def close_pairs(cold: DataFrame) -> DataFrame:
    """u, v: classes of one cell that differ by two bits at most. Points that coincide are compared in their own cell alone."""
    held = cold.groupBy("cell").agg(F.collect_list(F.struct("fp", "side")).alias("held")).where(F.size("held") > 1)
    one = held.select("held", F.explode("held").alias("a"))
    match = lambda b: (F.col("a.fp") < b["fp"]) & ((F.col("a.side") == 0) | (F.col("a.side") != b["side"])) & (F.bit_count(F.col("a.fp").bitwiseXOR(b["fp"])) <= RADIUS)
    return one.select(F.col("a.fp").alias("u"), F.explode(F.filter("held", match)).alias("b")).select("u", F.col("b.fp").alias("v"))


def finest_links(classes: DataFrame) -> DataFrame:
    """u, v: each class with the least of every cell of the finest grid in which it meets others."""
    flips = F.array(F.lit(0).cast("long"), *(F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(64)))
    near = classes.select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("cell"))
    met = near.groupBy("cell").agg(F.collect_list("fp").alias("held")).where(F.size("held") > 1)  # 65 at most
    return met.select(F.array_min("held").alias("u"), F.explode("held").alias("v")).where("u != v")


def links(classes: DataFrame) -> DataFrame:
    """u, v: links between different fingerprints (column fp, distinct), enough to connect all that are within two bits of each other."""
    near = cells(classes)
    crowded = materialise(near.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CROWD).select("cell"))
    if crowded.isEmpty():
        return close_pairs(near).distinct()
    few = sized(crowded)
    found = close_pairs(near.join(few, "cell", "left_anti"))
    return found.unionByName(finest_links(near.join(few, "cell", "left_semi").select("fp").distinct())).distinct()


def near_duplicates(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """A row per document: doc_id, fingerprint (16 hex digits), component_id (the least doc_id that links reach)."""
    rows = materialise(fingerprints(docs, width))
    classes = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    with recorded() as spent:
        roots = components(links(classes.select("fp")))
        named = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
        least = named.groupBy("root").agg(F.min("rep").alias("component_id"))
        named = materialise(named.join(least, "root").select("fp", "component_id"))
        spent.pop()
    drop_tables(docs.sparkSession, spent)
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return rows.join(named, "fp", "left").select("doc_id", digits, F.coalesce("component_id", "doc_id").alias("component_id"))
