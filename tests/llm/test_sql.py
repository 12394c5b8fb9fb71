"""What SQL can say of queries that it can't express whole: base counts, sizes and targets, hosts, paths and rules."""

from __future__ import annotations

import duckdb
import pytest

from veldspar.llm import queries

SF = "/root/testdata/sf0.001"
BLANK = r"\x20\x09-\x0D"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("documents", "pages"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def test_base_counts_of_quality_rules(spark, con):
    want = con.sql(rf"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^{BLANK}]+') AS w FROM documents),
        l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d), r AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM l WHERE regexp_matches(line, '[^{BLANK}]') GROUP BY 1),
        x AS (SELECT doc_id, i, array_to_string(w[i : i + 7], ' ') AS run FROM d, unnest(range(1, greatest(len(w) - 6, 1))) t(i)), y AS (SELECT *, count(*) OVER (PARTITION BY doc_id, run) AS n FROM x),
        z AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM y, range(8) t(k) WHERE n > 1 GROUP BY 1)
        SELECT d.doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda s: length(s))), 0)::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, coalesce(r.n, 0) AS n_dup_lines, coalesce(z.n, 0) AS n_repeat_words
        FROM d LEFT JOIN r ON r.doc_id = d.doc_id LEFT JOIN z ON z.doc_id = d.doc_id""").fetchall()
    got = queries.op5_quality_rules(spark, SF).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()
    assert sorted(tuple(r)[:6] for r in got) == sorted(want)
    assert all(r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"]) for r in got)


def test_sizes_and_targets_of_mixing(spark, con):
    sizes = con.sql(rf"SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^{BLANK}]+')) AS n, source FROM documents").fetchall()
    total = {}
    for _, n, s in sizes:
        total[s] = total.get(s, 0) + n
    order = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    open_, target, left = set(order), {}, float(sum(total.values()))
    while True:  # the excess is shared again by weight until no target is above three times its source
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > 3 * total[s]}
        if not full:
            target |= share
            break
        for s in full:
            target[s] = 3.0 * total[s]
            left -= target[s]
        open_ -= full
    got = {r["doc_id"]: r for r in queries.op2_entropy_mixing(spark, SF).collect()}
    assert len(got) == len(sizes)
    taken = {}
    for i, n, s in sizes:
        r = got[i]
        assert (r["size"], r["source_size"]) == (n, total[s]) and r["target"] == pytest.approx(target[s]) and 0 <= r["taken"] <= 3 * n
        taken[s] = taken.get(s, 0) + r["taken"]
    assert all(taken[s] == pytest.approx(target[s], rel=0.05) for s in order if total[s])


def test_hosts_paths_and_rules_of_the_url_filter(spark, con):
    rules = "('org', '/', 'allow', 'org/'), ('example.org', '/es/', 'block', 'example.org/es/'), ('example.org', '/en/1', 'block', 'example.org/en/1'), ('com', '/fr/', 'allow', 'com/fr/'), ('com', '/de/', 'block', 'com/de/')"
    want = con.sql(rf"""
        WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
        p AS (SELECT page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
        r(h, s, verdict, rule) AS (VALUES {rules}), m AS (SELECT p.*, rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC) AS n FROM p LEFT JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, s))
        SELECT page_id, host, path, rule, verdict FROM m WHERE n = 1""").fetchall()
    got = {r["page_id"]: r for r in queries.op3_url_filter(spark, SF).collect()}
    assert len(got) == len(want)
    for page, host, path, rule, verdict in want:
        r = got[page]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule) and (r["verdict"] == verdict if rule else r["verdict"] in ("allow", "block"))
