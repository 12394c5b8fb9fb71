"""Line deduplication by distinct-site spread (operator 7).

A line that stands on many sites is boilerplate. Per line hash, HyperLogLog sketches of its sites merge by aggregation;
an estimate clearly below or above the threshold decides, one near it is replaced by an exact distinct count. Lines that
occur less often than the threshold can't reach it and get no sketch. Of a boilerplate line the occurrence in the
smallest doc_id (and position) stays, so that the text isn't lost; all others are removed.

Defined results: lines are compared with blanks at both ends cut off; lines of fewer than `least_words` words are left
alone; a null site is a site of its own; null texts have no lines and stay null; a document all of whose worded lines go
keeps its other lines; repeated rows are treated alike (each keeps what the first keeps); empty tables give empty results.
Columns other than doc_id, text and the site are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veldspar.llm.common import BROADCAST_ROWS, materialise, sized

#: Distinct sites from which a line is boilerplate.
MIN_SITES = 10
#: Lines of fewer words are left alone: 1 takes every line with a word.
LEAST_WORDS = 1
#: Sketches of 2^LOG_K registers err by about 1.04 / sqrt(2^LOG_K); estimates within MARGIN of the threshold are counted exactly.
LOG_K = 10
MARGIN = 0.25
_BLANK = " \t\x0b\f\r"
_BLANKS = r"[ \t\x0B\f\r]+"


def _lines(docs: DataFrame, site: str, least_words: int) -> DataFrame:
    """doc (doc_id and hash of the text), site hash, pos and hash of each line with enough words."""
    bare = F.btrim(F.col("line"), F.lit(_BLANK))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), F.coalesce(F.xxhash64(F.col(site)), F.lit(0)).alias("site"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return rows.where((F.length(bare) > 0) & (F.size(F.split(bare, _BLANKS, least_words)) >= least_words)).select("doc_id", "th", "site", "pos", F.xxhash64(bare, F.length(bare)).alias("h"))


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """h, n_sites (exact near the threshold, else the sketch's estimate), and the occurrence that stays: first (doc_id, pos)."""
    often = lines.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "pos")).alias("first")).where(F.col("n") >= min_sites)
    often = materialise(often)
    near_all = lines.join(sized(often.select("h")), "h", "left_semi")
    sites = materialise(near_all.groupBy("h", "site").agg(F.count(F.lit(1)).alias("n")))  # one row per line and site: hot lines shrink before they meet
    est = materialise(sites.groupBy("h").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LOG_K))).alias("est")))
    near = est.where(F.col("est").between(int(min_sites * (1 - MARGIN)), int(min_sites * (1 + MARGIN)) + 1)).select("h")
    exact = sites.join(sized(materialise(near)), "h", "left_semi").groupBy("h").agg(F.count_distinct("site").alias("exact"))
    spread = est.join(exact, "h", "left").withColumn("n_sites", F.coalesce("exact", "est")).where(F.col("n_sites") >= min_sites)
    return materialise(spread.join(often, "h").select("h", "n_sites", F.col("first.doc_id").alias("first_doc"), F.col("first.pos").alias("first_pos")))


def removals(docs: DataFrame, bad: DataFrame, site: str, least_words: int) -> DataFrame:
    """doc_id, th (hash of the text), gone: positions of the lines to remove; only documents that lose a line."""
    hit = _lines(docs, site, least_words).join(sized(bad), "h")
    stays = F.col("doc_id").eqNullSafe(F.col("first_doc")) & (F.col("pos") == F.col("first_pos"))
    return hit.where(~stays).groupBy("doc_id", "th").agg(F.collect_set("pos").alias("gone"))  # at most a document's lines


def _cut(text: Column, gone: Column) -> Column:
    left = F.filter(F.split(text, "\n"), lambda x, i: ~F.array_contains(gone, i))
    return F.when(gone.isNull(), text).otherwise(F.array_join(left, "\n"))


def _joined(docs: DataFrame, site: str, min_sites: int, least_words: int, limit: int = 5 * BROADCAST_ROWS) -> DataFrame:
    """docs as struct __doc with __key, text and gone (positions of the lines to remove; null if there are none).

    The lists of lines go to the documents: by broadcast if they are few (counted, in rows and bytes), so that no text is shuffled, else by a
    hash join that shuffles each text once."""
    gone = materialise(removals(docs, boilerplate(_lines(docs, site, least_words), min_sites), site, least_words))
    gone = sized(gone.select(F.col("doc_id").alias("__id"), F.col("th").alias("__th"), "gone"), limit)
    rows = docs.select(F.struct(*docs.columns).alias("__doc"), F.col("doc_id").cast("long").alias("__key"))
    rows = rows.join(gone, F.col("__key").eqNullSafe(F.col("__id")) & (F.xxhash64("__doc.text") == F.col("__th")), "left")
    return rows.select("__doc", "__key", F.col("__doc.text").alias("text"), "gone")


def line_dedup(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES, least_words: int = LEAST_WORDS, limit: int = 5 * BROADCAST_ROWS) -> DataFrame:
    """doc_id, n_lines, n_removed, clean_chars (null for a null text), clean_text."""
    rows = _joined(docs, site, min_sites, least_words, limit).withColumn("clean", _cut(F.col("text"), F.col("gone")))
    n = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n"))).cast("long")
    return rows.select(F.col("__key").alias("doc_id"), n.alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"), F.length("clean").cast("long").alias("clean_chars"), F.col("clean").alias("clean_text"))


def without_boilerplate(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES, least_words: int = LEAST_WORDS, limit: int = 5 * BROADCAST_ROWS) -> DataFrame:
    """The documents with their texts cleaned (n_chars follows, if there); those that lose all their words go."""
    worded = F.size(F.filter(F.split("text", "\n"), lambda x: F.length(F.btrim(x, F.lit(_BLANK))) > 0))
    rows = _joined(docs, site, min_sites, least_words, limit).where(F.col("gone").isNull() | (F.size("gone") < worded))
    rows = rows.withColumn("clean", _cut(F.col("text"), F.col("gone")))
    own = [F.col("clean").alias(c) if c == "text" else F.when(F.col("gone").isNull(), F.col("__doc.n_chars")).otherwise(F.length("clean").cast("long")).alias(c) if c == "n_chars" else F.col(f"__doc.`{c}`").alias(c) for c in docs.columns]
    return rows.select(*own)
