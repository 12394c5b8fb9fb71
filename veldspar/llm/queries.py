"""The queries opN_<name> over their whole tables, with production parameters, and SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldspar.llm import addq, hardneg, jaccard, langid, linedup, merkle, mixing, packing, quality, simhash, substring, urlfilter, warc
from veldspar.llm.common import table

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op2_entropy_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge_urls(table(spark, sf_dir, "pages"))


def op4_additive_quantisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return addq.search(table(spark, sf_dir, "embeddings"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = langid.identify(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "held_out", "lang_pred", "score", F.array_join(F.transform("langs", lambda x: x["lang"]), " ").alias("langs"))


def op7_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = linedup.line_dedup(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_lines", "n_removed", "clean_chars", F.md5("clean_text").alias("clean_md5"))


def op8_packing_nnls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op9_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.passage_classes(table(spark, sf_dir, "documents"))


def op10_signature_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op11_simhash_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hardneg.mine(table(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_warc_salvage, op2_entropy_mixing, op3_url_filter, op4_additive_quantisation, op5_quality_rules,
        op6_language_mixture, op7_line_spread, op8_packing_nnls, op9_compact_windows, op10_signature_trees,
        op11_simhash_segments, op12_merkle_manifest, op13_hard_negatives,
    )
}

_BLANK = r"\x20\x09\x0B-\x0D"



def _crc32(text: str) -> str:
    """SQL of the unsigned crc32 of an ASCII text: its bytes, each followed by eight shifts (-1)."""
    steps = f"flatten(list_transform(string_split({text}, ''), lambda c: [ord(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))"
    step = "lambda a, e: CASE WHEN e >= 0 THEN xor(a, e) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {steps}), {step}), 4294967295)"


def _trie(name: str, levels: int) -> str:
    """SQL over {name}0 (g, idx, total, digest): {name}1 and so on, a level each; {name}p0 and so on, the siblings left and right of each node."""
    out = []
    for k in range(levels):
        nodes, span = f"{name}{k}", 8**k
        out.append(f"""{name}{k + 1} AS (SELECT g, idx // 8 AS idx, max(total) AS total,
            CASE WHEN max(total) > {span} THEN sha256(string_agg(digest, '' ORDER BY idx)) ELSE min(digest) END AS digest FROM {nodes} GROUP BY g, idx // 8)""")
        out.append(f"""{name}p{k} AS (SELECT g, idx, total > {span} AS steps,
            coalesce(string_agg(digest, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
            coalesce(string_agg(digest, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
            FROM {nodes} WINDOW w AS (PARTITION BY g, idx // 8 ORDER BY idx))""")
    return ", ".join(out)


def _climb(rows: str, name: str, levels: int) -> str:
    """SQL over {rows}0 (g, rank, digest, proof): {rows}1 and so on, digest and proof after each step up the trie {name}."""
    return ", ".join(
        f"""{rows}{k + 1} AS (SELECT t.* EXCLUDE (digest, proof), CASE WHEN steps THEN sha256(l || t.digest || r) ELSE t.digest END AS digest,
            CASE WHEN steps THEN t.proof || l || r ELSE t.proof END AS proof FROM {rows}{k} t JOIN {name}p{k} p ON p.g = t.g AND p.idx = t.rank // {8**k})"""
        for k in range(levels)
    )


_FIELD = "coalesce(strlen({0})::VARCHAR || ':' || {0}, '-')"
_ABC = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR")) + " || {0})"
#: Levels that the SQL climbs: up to 8^7 rows of a language, and 8^2 languages.
_LEVELS, _TOP = 7, 2

ORACLES = {
    "op12_merkle_manifest": f"""
        WITH d AS (SELECT doc_id, lang, coalesce('+' || lang, '-') AS g, {_LEAF.format(_FIELD.format("text"))} AS leaf,
            {_LEAF.format(_FIELD.format(f"translate(text, {_ABC})"))} AS lower_leaf, doc_id IS NOT NULL AND {_crc32("doc_id::VARCHAR")} % 3 = 0 AS tampered FROM documents),
        d0 AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS rank, count(*) OVER (PARTITION BY g) AS total FROM d),
        n0 AS (SELECT g, rank AS idx, total, leaf AS digest FROM d0), {_trie("n", _LEVELS)},
        r AS (SELECT g, (SELECT count(DISTINCT g) FROM d) AS total, digest FROM n{_LEVELS}),
        q AS (SELECT g, row_number() OVER (ORDER BY g <> '-', encode(substr(g, 2))) - 1 AS place FROM r),
        m0 AS (SELECT 'top' AS g, place AS idx, total, digest FROM r JOIN q USING (g)), {_trie("m", _TOP)},
        t0 AS (SELECT g, rank, doc_id, leaf, CASE WHEN tampered THEN lower_leaf ELSE leaf END AS digest, '' AS proof FROM d0), {_climb("t", "n", _LEVELS)},
        u0 AS (SELECT 'top' AS g, place AS rank, t.g AS lang_g, doc_id, leaf, digest, proof FROM t{_LEVELS} t JOIN q ON q.g = t.g), {_climb("u", "m", _TOP)}
        SELECT u.doc_id, u.leaf, r.digest AS subroot, m.digest AS root, sha256(u.proof) AS proof_sha256, u.digest AS folded_root, u.digest = m.digest AS verified
        FROM u{_TOP} u JOIN r ON r.g = u.lang_g, m{_TOP} m""",
    "op13_hard_negatives": """
        WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
                   FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS alike, list_inner_product(a.q, b.q)::BIGINT AS score
              FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)),
        p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE alike QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
        SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score
        FROM p JOIN s USING (anchor_id) WHERE NOT alike AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score QUALIFY rank <= 3""",
    "op1_warc_salvage": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, ''))::BIGINT AS n, sha1(coalesce(html, '')) AS d FROM pages),
        q AS (SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY d) END AS newest FROM p)
        SELECT page_id, n AS payload_bytes, d AS payload_digest,
               CASE WHEN newest IS NULL OR newest = page_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN newest <> page_id THEN newest END AS refers_to
        FROM q""",
    "op7_line_spread": f"""
        WITH s AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS ls FROM documents),
        l AS (SELECT doc_id, source, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM s),
        w AS (SELECT doc_id, source, pos, line, regexp_replace(line, '^[{_BLANK}]+|[{_BLANK}]+$', '', 'g') AS bare FROM l),
        k AS (SELECT *, bare <> '' AS counts FROM w),
        b AS (SELECT bare, min((doc_id, pos)) AS first FROM k WHERE counts GROUP BY bare
              HAVING count(DISTINCT source) + max((source IS NULL)::INT) >= {linedup.MIN_SITES}),
        g AS (SELECT k.*, b.bare IS NOT NULL AND (k.doc_id, k.pos) <> b.first AS gone FROM k LEFT JOIN b ON k.bare = b.bare AND k.counts)
        SELECT doc_id, count(*)::BIGINT AS n_lines, sum(gone::INT)::BIGINT AS n_removed,
               coalesce(length(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone)), 0)::BIGINT AS clean_chars,
               md5(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS clean_md5
        FROM g GROUP BY doc_id""",
}
