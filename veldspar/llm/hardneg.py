"""Hard-negative mining by a full score sort per anchor (operator 13).

Components become whole numbers (floor of 256 times each), and scores are integer inner products. The table is dealt into blocks of bounded size, and
anchors stream past each block in bounded groups: a task scores an anchor with every row of its block, so that no anchor's scores lie in one
task. A first pass keeps each block's best rows of the anchor's label, and their merge gives the positives. A second pass sorts
the block's scores of other labels for each anchor (lexsort by score, then id), finds the upper limit of every positive by binary
search, and reads k entries that are above the lower limit; the merge of the blocks' entries gives the first k overall.

Defined results: rows with a null id or label, a null vector, or a null or non-finite component take no part, nor do vectors whose whole numbers have
squares that sum to 2^62 or more (scores would leave 64 bits); vectors meet only others of their length, empty ones included (score 0); every row
counts for itself, so that repeated ids are anchors, positives and negatives each on their own and a copy of the anchor's row is another row; ties
go to the smaller id; anchors without positives and positives without negatives give no row; an empty table gives an empty result.
Columns other than vec_id, embedding and label are never read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veldspar.llm.common import materialise

EVERY, POSITIVES, NEGATIVES = 50, 5, 3
#: Limits of a negative's score, in hundredths of the positive's.
LOWEST, HIGHEST = 50, 95
SCALE = 256
#: Rows of a block: about a 24th of a small table, at most as many as a worker holds with their vectors.
BLOCK_ROWS = (4_096, 65_536)
BLOCK_BYTES = 64 << 20
#: Scores that a task holds at a time.
SCORES = 1 << 21

Search = Callable[[dict, np.ndarray, np.ndarray, np.ndarray, np.ndarray], Iterator[tuple]]


def quantised(rows: DataFrame, relabel_every: int = 7, labels: int = 10) -> DataFrame:
    """row (a number of its own), vec_id, label, q (array<long>), d (length), of what takes part."""
    label = F.col("label").cast("long")
    label = F.when(F.col("vec_id") % relabel_every == 0, (label + 1) % labels).otherwise(label)
    v = rows.select(F.col("vec_id").cast("long"), label.alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    v = v.where("vec_id is not null and label is not null and v is not null")
    v = v.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    v = v.where(F.aggregate("v", F.lit(0.0), lambda s, x: s + (x * SCALE) * (x * SCALE)) < 2.0**62)
    q = F.transform("v", lambda x: F.floor(x * SCALE))
    return v.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", q.alias("q"), F.size("v").alias("d"))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), d)


def _past_blocks(search: Search, names: list[str]):
    """Over rows sorted by block and kind: holds a block (kind 0), then answers its anchors (kind 1) as they come."""

    def scores(anchors: np.ndarray, block: np.ndarray) -> np.ndarray:
        largest = np.sqrt((anchors.astype(np.float64) ** 2).sum(1).max() * (block.astype(np.float64) ** 2).sum(1).max(initial=0))
        if anchors.shape[1] and largest * anchors.shape[1] < 2**52:  # every partial sum is exact in double precision
            return (anchors.astype(np.float64) @ block.T.astype(np.float64)).astype(np.int64)
        return anchors @ block.T

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, block = None, [], None
        for b in batches:
            key, kind = b.column("block").to_numpy(), b.column("kind").to_numpy()
            cuts = [0, *(np.flatnonzero((np.diff(key) != 0) | (np.diff(kind) != 0)) + 1), b.num_rows]
            for i, j in zip(cuts, cuts[1:], strict=False):
                if i == j:
                    continue
                part = b.slice(i, j - i)
                if key[i] != now:
                    now, held, block = key[i], [], None
                cols = [part.column(c).to_numpy() for c in ("row", "vec_id", "label")] + [_matrix(part.column("q"), part.column("d")[0].as_py())]
                if kind[i] == 0:
                    held.append(cols)
                    continue
                if block is None:
                    if not held:
                        continue
                    block, held = [np.concatenate(x) for x in zip(*held, strict=True)], []
                ids = dict(zip(("row", "vec_id", "label"), block[:3], strict=True))
                step = max(1, SCORES // len(block[0]))
                for s in range(0, j - i, step):
                    some = part.slice(s, step)
                    found = list(search(ids, *(c[s : s + step] for c in cols[:3]), scores(cols[3][s : s + step], block[3]), some))
                    if found:
                        yield pa.record_batch([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], names)

    return run


def _best_of_label(k: int):
    """Of each anchor: the block's k best other rows of its label."""

    def search(block, rows, vec_ids, labels, scores, _part):
        for row, vec_id, label, score in zip(rows, vec_ids, labels, scores, strict=True):
            at = np.flatnonzero((block["label"] == label) & (block["row"] != row))
            if len(at) > k:  # ties of the k-th score stay until the ids decide
                at = at[score[at] >= np.partition(score[at], len(at) - k)[len(at) - k]]
            at = at[np.lexsort((block["row"][at], block["vec_id"][at], -score[at]))[:k]]
            if len(at):
                yield np.full(len(at), row), np.full(len(at), vec_id), block["row"][at], block["vec_id"][at], score[at]

    return search


def _below_positives(k: int):
    """Of each anchor and positive: the block's first k rows of another label between the limits."""

    def search(block, rows, vec_ids, labels, scores, part):
        numbers, limits = part.column("numbers"), part.column("limits")
        for i, (row, label, score) in enumerate(zip(rows, labels, scores, strict=True)):
            number, positive = (np.asarray(c[i].values.to_numpy(zero_copy_only=False)) for c in (numbers, limits))
            low, high = -((-LOWEST * positive) // 100), (HIGHEST * positive) // 100
            at = np.flatnonzero(block["label"] != label)
            at = at[np.lexsort((block["row"][at], block["vec_id"][at], -score[at]))]
            falling = score[at]
            begin = np.searchsorted(-falling, -high, "left")
            end = np.minimum(np.searchsorted(-falling, -low, "right"), begin + k)
            for n, p, s, e in zip(number, positive, begin, end, strict=True):
                if e > s:
                    yield np.full(e - s, row), np.full(e - s, n), np.full(e - s, p), block["row"][at[s:e]], block["vec_id"][at[s:e]], falling[s:e]

    return search


def mine(rows: DataFrame, every: int = EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    base = materialise(quantised(rows))
    total, width = base.agg(F.count(F.lit(1)), F.coalesce(F.max("d"), F.lit(0))).first()
    size = max(1, min(max(total // 24, BLOCK_ROWS[0]), BLOCK_ROWS[1], BLOCK_BYTES // (8 * max(1, width))))
    blocks = max(1, -(-total // size))
    extra = {"numbers": F.lit(None).cast("array<int>"), "limits": F.lit(None).cast("array<long>")}
    number = F.xxhash64("d", F.pmod(F.xxhash64("row"), F.lit(blocks))).alias("block")
    stored = base.select(number, F.lit(0).alias("kind"), "row", "vec_id", "label", "q", "d").withColumns(extra)
    anchors = base.where(F.col("vec_id") % every == 0)

    def past(some: DataFrame, search: Search, schema: str) -> DataFrame:
        dealt = some.withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
        dealt = dealt.select(F.xxhash64("d", "b").alias("block"), F.lit(1).alias("kind"), "row", "vec_id", "label", "q", "d", "numbers", "limits")
        both = stored.unionByName(dealt).repartition(min(blocks, 4_096), "block").sortWithinPartitions("block", "kind")
        return both.mapInArrow(_past_blocks(search, [c.split()[0] for c in schema.split(", ")]), schema)

    def first(found: DataFrame, keys: list[str], score: str, vec_id: str, row: str, k: int, name: str) -> DataFrame:
        """The first k of each key over all blocks: each block gave at most k."""
        at = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(score), vec_id, row))
        return found.withColumn(name, at).where(F.col(name) <= k)

    own = past(anchors.withColumns(extra), _best_of_label(positives), "row long, anchor_id long, positive_row long, positive_id long, positive_score long")
    own = materialise(first(own, ["row"], "positive_score", "positive_id", "positive_row", positives, "number"))
    lists = own.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("number", "positive_score"))).alias("p"))  # at most `positives` each
    asked = anchors.join(lists, "row").withColumns({"numbers": F.col("p.number"), "limits": F.col("p.positive_score")})
    found = past(asked, _below_positives(negatives), "row long, number int, positive_score long, negative_row long, negative_id long, negative_score long")
    found = first(found, ["row", "number"], "negative_score", "negative_id", "negative_row", negatives, "rank")
    named = found.join(own.select("row", "number", "anchor_id", "positive_id"), ["row", "number"])
    return named.select("anchor_id", "positive_id", F.col("rank").cast("int"), "negative_id", "positive_score", "negative_score")
