"""Connected components over links that never leave the executors (alternating large-star and small-star rounds)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veldspar.tables import drop_tables, materialise, recorded


def _star(edges: DataFrame, large: bool) -> DataFrame:
    both = edges.select("u", "v")
    if large:
        both = both.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = both.join(least.hint("merge"), "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where("u != v").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """edges: u, v (of one orderable type). Gives node, root (the least node of its component) for every node of an edge but the roots.

    Each round's links are a table; rounds grow with the logarithm of the longest chain. Raises if they don't suffice."""
    with recorded() as held:
        cur = materialise(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct())
    mark = None
    for _ in range(rounds):
        new = cur.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if new == mark or new[0] == 0:
            return cur.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = new
        with recorded() as made:
            cur = materialise(_star(materialise(_star(cur, True)), False))
        drop_tables(cur.sparkSession, held + made[:-1])  # only this round's links are read on
        held = made[-1:]
    raise RuntimeError(f"components have not converged in {rounds} rounds")
