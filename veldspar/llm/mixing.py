"""Mixing sources to target token shares by entropy balancing (operator 2; DataFrame functions only).

Each document gets a rate r = min(3, exp(lambda_s * size / mean size of its source)): the distribution of rates closest
in relative entropy to "every document once" whose expected tokens meet the source's target. lambda_s solves the convex
dual; Newton's steps (with a bracket as safeguard) run over the table of (source, size, documents), which holds all that
the dual depends on. Rates become copies: the whole part, and one more copy for the documents of lowest
hash / fraction until the source's target is met; then a few single copies are exchanged to close what is left.

Defined results: a null source is a source (last in order); null or wordless texts have size 0 and take nothing; a
source of size 0 has target 0; repeated rows get the same number of copies; reruns agree; an empty table gives an empty
result. Columns other than doc_id, text and source are never read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veldspar.llm.common import BROADCAST_ROWS, materialise

CAP = 3
WEIGHTS = (5, 2, 1)
#: Bins of the order of extra copies, and parts of the bin in which a source's target is met.
BINS, SUB = 8192, 4096
ROUNDS = 4
_BLANK = " \t\n\x0b\f\r"


def n_words(text: Column) -> Column:
    bare = F.coalesce(F.btrim(text, F.lit(_BLANK)), F.lit(""))
    return F.when(bare == "", 0).otherwise(F.size(F.split(bare, r"[ \t\n\x0B\f\r]+"))).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """sizes: source, source_size. Adds target: shares of the total by weight, capped at cap times the size, the excess reshared.

    The fixed point of resharing is a water level t: target = min(cap * size, weight * t)."""
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.col("i") - 1) % len(weights) + 1).cast("int")).cast("double")
    rows = sizes.withColumn("i", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))).withColumn("w", w)
    rows = rows.withColumn("most", F.col("source_size").cast("double") * cap)
    order = Window.orderBy(F.col("most") / F.col("w"), "i")
    all_rows = Window.partitionBy()
    rows = rows.withColumn("total", F.sum("source_size").over(all_rows).cast("double"))
    rows = rows.withColumn("capped", F.sum("most").over(order) - F.col("most"))
    rows = rows.withColumn("weight_left", F.sum("w").over(all_rows) - F.sum("w").over(order) + F.col("w"))
    rows = rows.withColumn("t", F.greatest(F.col("total") - F.col("capped"), F.lit(0.0)) / F.col("weight_left"))
    level = F.min(F.when(F.col("w") * F.col("t") <= F.col("most"), F.struct(F.col("most") / F.col("w"), F.col("i"), F.col("t").alias("t")))).over(all_rows)["t"]
    return rows.select("source", "source_size", F.least("most", F.coalesce(F.col("w") * level, F.col("most"))).alias("target"))


def _newton(hist: DataFrame, state: DataFrame, hint, tolerance: float = 1e-6, rounds: int = 200) -> DataFrame:
    """hist: source, size, n. state: source, source_size, target, mean. Adds lam; null where every rate is the cap."""
    full = F.col("target") >= CAP * F.col("source_size") * (1 - 1e-9)
    cur = materialise(state.withColumn("lam", F.when(full, None).otherwise(F.lit(0.0))).withColumn("lo", F.lit(-1e9)).withColumn("hi", F.lit(1e9)).withColumn("done", full))
    for _ in range(rounds):
        if cur.where("not done").isEmpty():
            break
        x = F.col("size") / F.col("mean")
        e = F.exp(F.least(F.col("lam") * x, F.lit(float(CAP)).cast("double")))
        rate = F.least(F.lit(float(CAP)), e)
        tokens = F.col("n") * F.col("size")
        live = cur.where("not done").select(F.col("source").alias("s"), "mean", "lam")
        sums = hist.join(hint(live), F.col("source").eqNullSafe(F.col("s"))).groupBy("s").agg(
            F.sum(tokens * rate).alias("g"), F.sum(F.when(e < CAP, tokens * x * e).otherwise(0.0)).alias("h")
        )
        both = cur.join(hint(sums), F.col("source").eqNullSafe(F.col("s")), "left")
        over = F.col("g") > F.col("target")
        lo, hi = F.when(over, F.col("lo")).otherwise(F.col("lam")), F.when(over, F.col("lam")).otherwise(F.col("hi"))
        both = both.withColumn("l", lo).withColumn("u", hi).withColumn("next", F.col("lam") - F.try_divide(F.col("g") - F.col("target"), F.col("h")))
        # far brackets are halved in scale, not in place, so that either sign is reached in a few steps
        mid = F.when(F.col("l") < -1e8, F.col("lam") * 4 - 1).when(F.col("u") > 1e8, F.col("lam") * 4 + 1).otherwise((F.col("l") + F.col("u")) / 2)
        step = F.when((F.col("next") > F.col("l")) & (F.col("next") < F.col("u")), F.col("next")).otherwise(mid)
        met = (F.abs(F.col("g") - F.col("target")) <= tolerance * F.greatest(F.col("target"), F.lit(1.0))) | (F.col("u") - F.col("l") < 1e-12 * (1 + F.abs("lam")))
        cur = materialise(both.select(
            "source", "source_size", "target", "mean",
            F.when(F.col("done") | met, F.col("lam")).otherwise(step).alias("lam"),
            F.when(F.col("done"), F.col("lo")).otherwise(F.col("l")).alias("lo"),
            F.when(F.col("done"), F.col("hi")).otherwise(F.col("u")).alias("hi"),
            (F.col("done") | met).alias("done"),
        ))
    else:
        raise RuntimeError(f"the dual has not converged in {rounds} Newton steps")
    return cur.select("source", "source_size", "target", "mean", "lam")


def _with_rate(rows: DataFrame, plan: DataFrame, hint) -> DataFrame:
    """rows: doc_id, source, size and more, joined to the plan of their source; adds base, frac and v, the order of the extra copy."""
    right = hint(plan.withColumnRenamed("source", "__s"))
    r = rows.join(right, F.col("source").eqNullSafe(F.col("__s")), "left").drop("__s")
    rate = F.when(F.col("size") == 0, 1.0).when(F.col("lam").isNull(), float(CAP)).otherwise(F.least(F.lit(float(CAP)), F.exp(F.least(F.col("lam") * F.col("size") / F.col("mean"), F.lit(2.0)))))
    r = r.withColumn("rate", rate).withColumn("base", F.floor("rate").cast("long")).withColumn("frac", F.col("rate") - F.col("base"))
    u = (F.shiftrightunsigned(F.xxhash64("doc_id", "size"), 11) + 1) / F.lit(float(1 << 53))
    r = r.withColumn("v", F.when((F.col("frac") > 0) & (F.col("size") > 0), u / F.col("frac")))
    x = F.col("v") / (1 + F.col("v")) * BINS  # all of v in bins that grow with it
    return r.withColumn("bin", F.floor(x).cast("long")).withColumn("sub", F.floor((x - F.floor(x)) * SUB).cast("long"))


def _chosen() -> Column:
    """Whether the plan of the source gives a document its extra copy, before exchanges."""
    at = F.struct("v", "doc_id")
    within = (F.col("sub") < F.col("sub_edge")) | ((F.col("sub") == F.col("sub_edge")) & F.coalesce(at <= F.col("last"), F.lit(False)))
    return F.coalesce((F.col("bin") < F.col("edge")) | ((F.col("bin") == F.col("edge")) & within), F.lit(False))


def mixing_plan(meta: DataFrame) -> tuple[DataFrame, Callable]:
    """meta: doc_id, source, size. A row per source that makes the number of copies a function of a document's own row; and how to join it (broadcast if few sources were counted)."""
    hist = materialise(meta.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")))
    sizes = materialise(hist.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("docs")))
    hint = F.broadcast if sizes.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else (lambda right: right)
    means = sizes.select(F.col("source").alias("s"), F.greatest(F.col("source_size") / F.col("docs"), F.lit(1e-9)).alias("mean"))
    state = source_targets(sizes.select("source", "source_size")).join(means, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    plan = _newton(hist, state, hint)
    rated = _with_rate(meta, plan, hint)
    # tokens of extra copies by bin of v, then by part of the bin where the target is met, then exactly within that part
    bins = rated.groupBy("source", "bin").agg(F.sum(F.col("size") * F.col("base")).alias("fixed"), F.sum(F.when(F.col("v").isNotNull(), F.col("size")).otherwise(0)).alias("extra"))
    by = Window.partitionBy("source").orderBy(F.col("bin").asc_nulls_first())
    bins = materialise(bins.withColumn("upto", F.sum("extra").over(by)).withColumn("fixed", F.sum("fixed").over(Window.partitionBy("source"))))
    need = bins.join(hint(plan.select(F.col("source").alias("s"), "target")), F.col("source").eqNullSafe(F.col("s"))).withColumn("need", F.col("target") - F.col("fixed"))
    edges = need.groupBy("source").agg(
        F.first("need").alias("need"), F.coalesce(F.min(F.when(F.col("upto") > F.col("need"), F.col("bin"))), F.lit(BINS + 1)).alias("edge"),
        F.coalesce(F.max(F.when(F.col("upto") <= F.col("need"), F.col("upto"))), F.lit(0)).alias("before"),
    )
    edges = materialise(edges)
    at_edge = rated.join(hint(edges.select(F.col("source").alias("s"), "edge", "need", "before")), F.col("source").eqNullSafe(F.col("s")) & (F.col("bin") == F.col("edge")))
    parts = at_edge.groupBy("source", "sub").agg(F.sum("size").alias("part"), F.first("need").alias("need"), F.first("before").alias("before"))
    parts = parts.withColumn("upto", F.col("before") + F.sum("part").over(Window.partitionBy("source").orderBy("sub")))  # at most SUB rows a source
    sub_edges = materialise(parts.groupBy("source").agg(
        F.coalesce(F.min(F.when(F.col("upto") > F.col("need"), F.col("sub"))), F.lit(SUB)).alias("sub_edge"), F.coalesce(F.max(F.when(F.col("upto") <= F.col("need"), F.col("upto"))), F.first("before")).alias("reached"),
    ))
    run = Window.partitionBy("source").orderBy("v", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    there = at_edge.join(hint(sub_edges.select(F.col("source").alias("s2"), "sub_edge", "reached")), F.col("source").eqNullSafe(F.col("s2")) & (F.col("sub") == F.col("sub_edge")))
    last = there.withColumn("sum", F.col("reached") + F.sum("size").over(run)).where(F.col("sum") <= F.col("need")).groupBy("source").agg(F.max(F.struct("v", "doc_id")).alias("last"))
    plan = plan.join(hint(edges.select(F.col("source").alias("s"), "edge")), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    plan = plan.join(hint(sub_edges.select(F.col("source").alias("s"), "sub_edge")), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    plan = plan.join(hint(last.withColumnRenamed("source", "s")), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    no = F.array().cast("array<struct<doc_id:bigint,size:bigint,by:bigint>>")
    plan = materialise(plan.withColumn("swaps", no))
    for _ in range(ROUNDS):
        rows = _with_rate(meta, plan, hint).withColumn("chosen", _chosen())
        swapped = F.exists("swaps", lambda s: s["doc_id"].eqNullSafe(F.col("doc_id")) & (s["size"] == F.col("size")))
        left = rows.groupBy("source").agg((F.first("target") - F.sum(F.col("size") * copies())).alias("gap"))
        left = materialise(left)
        rows = rows.where("size > 0").where(~swapped).join(hint(left.withColumnRenamed("source", "s")), F.col("source").eqNullSafe(F.col("s"))).drop("s")
        by = F.when((F.col("base") + F.col("chosen").cast("int") < CAP) & (F.col("gap") > 0), F.lit(1)).when((F.col("chosen") | (F.col("base") > 0)) & (F.col("gap") < 0), F.lit(-1))
        rows = rows.withColumn("by", by.cast("long")).where("by is not null").withColumn("rest", F.abs(F.col("gap") - F.col("by") * F.col("size"))).where(F.col("rest") < F.abs("gap"))
        best = rows.groupBy("source").agg(F.min(F.struct("rest", "doc_id", "size", "by")).alias("b"))
        step = plan.join(hint(best.withColumnRenamed("source", "s")), F.col("source").eqNullSafe(F.col("s")), "left")
        one = F.array(F.struct(F.col("b.doc_id").alias("doc_id"), F.col("b.size").alias("size"), F.col("b.by").alias("by")))
        plan = materialise(step.withColumn("swaps", F.when(F.col("b").isNull(), F.col("swaps")).otherwise(F.concat("swaps", one))).drop("s", "b"))
    return plan, hint


def copies() -> Column:
    """Copies of a row that _with_rate has joined to its plan."""
    extra = F.aggregate("swaps", F.lit(0).cast("long"), lambda a, s: a + F.when(s["doc_id"].eqNullSafe(F.col("doc_id")) & (s["size"] == F.col("size")), s["by"]).otherwise(0))
    return F.col("base") + _chosen().cast("long") + extra


def mix(docs: DataFrame) -> DataFrame:
    """A row per document: doc_id, source, size, source_size, target, copies, taken."""
    meta = materialise(docs.select(F.col("doc_id").cast("long"), "source", n_words(F.col("text")).alias("size")))
    rows = _with_rate(meta, *mixing_plan(meta)).withColumn("copies", copies())
    return rows.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame) -> DataFrame:
    """The documents, each as often as the mix takes it, with their own columns."""
    meta = materialise(docs.select(F.col("doc_id").cast("long"), "source", n_words(F.col("text")).alias("size")))
    plan, hint = mixing_plan(meta)
    rows = docs.select(F.struct(*docs.columns).alias("__doc"), F.col("doc_id").cast("long"), "source", n_words(F.col("text")).alias("size"))
    rows = _with_rate(rows, plan, hint).withColumn("copies", copies()).where("copies > 0")
    return rows.select("__doc", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("__i")).select("__doc.*")
