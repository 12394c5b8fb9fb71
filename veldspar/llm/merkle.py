"""A Merkle manifest of a dataset by a radix-ranked trie (operator 12).

A row's leaf is a hash of its fields. The leaves of a group (a language) ascend by doc_id, and their ranks come without a global sort: the key
is a text of hex digits, histograms count the keys under every prefix of it, each level rolled up from the one below, and a key's rank is the sum of
the counts of smaller prefixes beside its own at every level, plus its place in its last bucket of at most BUCKET keys. Ranks in base eight key
the nodes of a trie: a node's children share all its digits. Nodes are reduced level by level until a group has one left, its subroot; subroots,
ranked in the same way, are the leaves of one more tree. Paths then go down again, one join a level, on the nodes alone: a node holds
its children's digests, so that leaves are met by a join only at their parents.

Defined results: a null field is `-` in a leaf; a null language is a group of its own, ahead of all others; a null doc_id stands before all others;
repeated doc_ids are leaves of their own, in the order of their leaves' digests, repeated rows in any order among themselves; a group of one row has its leaf as
subroot, a table of one group its subroot as root; a leaf without siblings has the hash of nothing as proof; doc_ids and n_chars are whole numbers; an empty
table gives an empty result. Columns other than doc_id, source, lang, n_chars and text are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veldspar.llm.common import drop_tables, materialise, recorded, sized

FANOUT = 8
#: Hex digits that a level of the histograms adds (4096 prefixes at most under each), and keys that a last bucket may hold.
DIGITS, BUCKET = 3, 16_384
#: Hex digits of a leaf's key that its last bucket has in common with others: null or not, and all but three of the id's sixteen.
ID_PREFIX = 14


def sha(c: Column) -> Column:
    return F.sha2(c, 256)


def leaf(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    """H of the fields: `-` if null, else byte count, colon, value."""
    fields = [doc_id.cast("string"), source.cast("string"), lang.cast("string"), n_chars.cast("string"), text]
    return sha(F.concat(*(F.coalesce(F.concat(F.octet_length(f).cast("string"), F.lit(":"), f), F.lit("-")) for f in fields)))


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def leaves(docs: DataFrame) -> DataFrame:
    """g (group), lang, key (hex digits in leaf order), doc_id, leaf, changed (the tampered row's leaf, null if it isn't tampered with)."""
    doc_id, n_chars = F.col("doc_id").cast("long"), F.col("n_chars").cast("long")
    rest = (F.col("source"), F.col("lang"), n_chars)
    tampered = (F.crc32(doc_id.cast("string").cast("binary")) % 3) == 0
    rows = docs.select(
        F.coalesce(F.concat(F.lit("+"), "lang"), F.lit("-")).alias("g"), "lang", doc_id.alias("doc_id"), leaf(doc_id, *rest, F.col("text")).alias("leaf"),
        F.when(tampered, leaf(doc_id, *rest, lower_ascii(F.col("text")))).alias("changed"), F.monotonically_increasing_id().alias("row"),
    )
    order = F.coalesce(F.concat(F.lit("1"), _hex(doc_id.bitwiseXOR(F.lit(-(1 << 63))))), F.lit("0" * 17))
    return rows.select("g", "lang", F.concat(order, F.substring("leaf", 1, 16), _hex(F.col("row"))).alias("key"), "doc_id", "leaf", "changed")


def _hex(c: Column) -> Column:
    return F.lower(F.lpad(F.hex(c), 16, "0"))


def _prefix(length: int) -> Column:
    return F.substring("key", 1, length).alias("prefix")


def ranked(rows: DataFrame, prefix: int = ID_PREFIX) -> DataFrame:
    """rows (a table with g and key, keys distinct within a group) with rank, from 0 in the order of keys, and total, the group's size.

    Buckets are keys with a common prefix. While one has more than BUCKET keys (repeated ids), prefixes get longer."""
    longest = rows.agg(F.max(F.length("key"))).first()[0] or 0
    while True:
        with recorded() as made:
            lowest = materialise(rows.groupBy("g", _prefix(prefix)).agg(F.count(F.lit(1)).alias("n")))
        if prefix >= longest or (lowest.agg(F.max("n")).first()[0] or 0) <= BUCKET:
            break
        drop_tables(rows.sparkSession, made)
        prefix += DIGITS
    lengths = list(range(prefix, 0, -DIGITS))
    levels = [lowest]
    for length in lengths[1:]:
        levels.append(levels[-1].groupBy("g", F.substring("prefix", 1, length).alias("prefix")).agg(F.sum("n").alias("n")))
    before = levels[-1].groupBy("g").agg(F.sum("n").alias("total")).select("g", "total", F.lit("").alias("up"), F.lit(0).cast("long").alias("base"))
    beside = Window.partitionBy("g", "up").orderBy("prefix").rowsBetween(Window.unboundedPreceding, -1)
    for level, parent in zip(reversed(levels), [0, *reversed(lengths[1:])], strict=True):
        own = level.withColumn("up", F.substring("prefix", 1, parent)).withColumn("smaller", F.coalesce(F.sum("n").over(beside), F.lit(0)))
        before = own.join(before, ["g", "up"]).select("g", "total", F.col("prefix").alias("up"), (F.col("base") + F.col("smaller")).alias("base"))
    before = materialise(before)
    place = F.row_number().over(Window.partitionBy("g", "up").orderBy("key"))
    placed = rows.withColumn("up", _prefix(prefix)).withColumn("place", place)
    return placed.join(sized(before), ["g", "up"]).select(*rows.columns, (F.col("base") + F.col("place") - 1).alias("rank"), "total")


def reduced(nodes: DataFrame, kept: list[str]) -> list[DataFrame]:
    """Levels of the trie over nodes (g, rank, total, digest, and what is kept of them): level k has g, idx (the rank without its last k digits), total (the group's leaves),
    digest and kids (idx, digest and, at the first level, what is kept). Level 1 holds every group; higher ones those with several nodes below. Tables."""
    kid = F.struct(F.col("rank").alias("idx"), "digest", *kept)
    out, span = [], FANOUT
    rows = nodes.select("g", "total", F.expr(f"rank div {FANOUT}").alias("idx"), kid.alias("kid"))
    while True:
        up = rows.groupBy("g", "total", "idx").agg(F.sort_array(F.collect_list("kid")).alias("kids"))  # eight at most
        joined = F.concat_ws("", F.transform("kids", lambda k: k["digest"]))
        single = (F.col("total") == 1) if span == FANOUT else F.lit(False)
        out.append(materialise(up.withColumn("digest", F.when(single, F.col("kids")[0]["digest"]).otherwise(sha(joined)))))
        if (out[-1].agg(F.max("total")).first()[0] or 0) <= span:
            return out
        rows = out[-1].where(F.col("total") > span).select("g", "total", F.expr(f"idx div {FANOUT}").alias("idx"), F.struct("idx", "digest").alias("kid"))
        span *= FANOUT


def subroots(levels: list[DataFrame]) -> DataFrame:
    """g, digest: the node of each group that is left at the end."""
    out, span = None, FANOUT
    for level in levels:
        last = level.where((F.col("total") <= span) & (F.col("total") > (span // FANOUT if span > FANOUT else 0))).select("g", F.col("digest").alias("subroot"))
        out, span = last if out is None else out.unionByName(last), span * FANOUT
    return out


def _step(at: Column) -> Column:
    """The siblings left and right of child number at (from 1) of kids."""
    side = lambda c: F.concat_ws("", F.transform(c, lambda k: k["digest"]))
    return F.array(F.struct(side(F.slice("kids", 1, at - 1)).alias("left"), side(F.slice("kids", at + 1, FANOUT)).alias("right")))


def paths(levels: list[DataFrame], top: DataFrame) -> DataFrame:
    """Level 1 with path: the siblings (left, right) of every step from the node up. top: g, path (that of the group's subroot)."""
    top, above, span = sized(top), None, FANOUT ** len(levels)
    for level in reversed(levels):
        ends = level.where((F.col("total") <= span) & (F.col("total") > (span // FANOUT if span > FANOUT else 0))).join(top, "g")
        rows = ends if above is None else ends.unionByName(level.join(above, ["g", "idx"]))
        if span == FANOUT:
            return rows
        rows = materialise(rows.drop("digest"))
        down = rows.select("g", "path", "kids", F.posexplode("kids").alias("at", "kid"))
        above = down.select("g", "kid.idx", F.concat(_step(F.col("at") + 1), "path").alias("path"))
        span //= FANOUT
    raise ValueError("a trie has one level at least")


def opened(level: DataFrame) -> DataFrame:
    """The leaves under the first level's nodes: g, leaf fields as kept, path (from the leaf to the root)."""
    down = level.select("g", "total", "path", "kids", F.posexplode("kids").alias("at", "kid"))
    path = F.when(F.col("total") == 1, F.col("path")).otherwise(F.concat(_step(F.col("at") + 1), "path"))
    return down.select("g", "kid.*", path.alias("path"))


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf's digest and its siblings give."""
    return F.aggregate(path, start, lambda digest, s: sha(F.concat(s["left"], digest, s["right"])))


def manifest(docs: DataFrame) -> DataFrame:
    """A row per document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified."""
    spark = docs.sparkSession
    rows = materialise(leaves(docs))
    with recorded() as spent:
        levels = reduced(ranked(rows).withColumnRenamed("leaf", "digest"), ["doc_id", "changed"])
        ends = subroots(levels)
        langs = rows.groupBy("g").agg(F.first("lang").alias("lang"))
        key = F.coalesce(F.concat(F.lit("1"), F.hex(F.col("lang").cast("binary"))), F.lit("0"))
        groups = materialise(ends.join(langs, "g").select(F.lit("").alias("g"), F.col("g").alias("lang_g"), key.alias("key"), "subroot"))
        tops = reduced(ranked(groups, 5).withColumnRenamed("subroot", "digest"), ["lang_g"])
        root = subroots(tops).withColumnRenamed("subroot", "root")  # g (empty), root: one row
        nothing = F.array().cast("array<struct<left:string,right:string>>")
        top = opened(paths(tops, root.select("g", nothing.alias("path")))).join(root, "g")
        top = materialise(top.select(F.col("lang_g").alias("g"), F.col("digest").alias("subroot"), "path", "root"))
        out = opened(paths(levels, top.select("g", "path"))).join(sized(top.drop("path")), "g")
        proof = sha(F.concat_ws("", F.transform("path", lambda s: F.concat(s["left"], s["right"])))).alias("proof_sha256")
        back = folded(F.coalesce("changed", "digest"), F.col("path")).alias("folded_root")
        out = materialise(out.select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", proof, back))
        spent.pop()
    drop_tables(spark, spent)
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
