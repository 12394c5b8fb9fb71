"""Edge cases of all operators on one awkward table, and brute-force comparisons."""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
import pytest

from veldspar.llm import addq, jaccard, langid, linedup, mixing, packing, quality, substring, urlfilter, warc
from veldspar.llm.queries import tokenizer_path

LONG = " ".join(f"word{i % 977}x{i % 31}" for i in range(30_000))
PASSAGE = " ".join(f"pass{i}" for i in range(60))
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog and runs away from the old bear today", "en", "a"),
    (2, "The quick brown fox jumps over the lazy dog and runs away from the old bear today", "en", "b"),
    (2, "The quick brown fox jumps over the lazy dog and runs away from the old bear today", "en", "b"),
    (3, None, "en", "a"), (4, "", None, None), (5, " \n\t ", "fr", "b"), (None, "a text without a number of its own", "fr", None),
    (6, LONG, "en", "a"), (7, f"before it {PASSAGE} after it", "en", "c"), (8, f"quite another start {PASSAGE} end", "en", None),
    (9, "élan vital été garçon où naïve", "fr", "c"), (10, "12345 67890 !!", "de", "c"), (11, "one two", "de", "c"), (12, "one two", "de", "a"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n long, h string, size int, cid string, rank int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, 1, "x", 2, "c", 3) for r in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (None, 1, 0), (7, None, 0), (8, 0, 0)], "doc_id long, quality int, toxic int")


def test_quality_base_counts(spark, docs, labels):
    got = {r["doc_id"]: r for r in quality.quality_rules(docs, labels).collect()}
    assert got[3]["n_words"] == got[4]["n_words"] == got[5]["n_words"] == 0 and got[3]["base_failed"]
    assert got[1]["n_words"] == 17 and got[6]["n_words"] == 30_000 and not got[1]["kept"]
    words = LONG.split()
    seen: dict = {}
    for i in range(len(words) - 7):
        seen.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {p + k for at in seen.values() if len(at) > 1 for p in at for k in range(8)}
    assert got[6]["n_repeat_words"] == len(covered)
    assert quality.keep_good(docs, labels).columns == docs.columns
    assert quality.quality_rules(docs.limit(0), labels.limit(0)).count() == 0


def test_binomial_tail_is_exact(spark):
    from pyspark.sql import functions as F

    cases = [(0, 60, 0.05), (3, 200, 0.01), (40, 1000, 0.05), (7, 7, 0.3)]
    for k, n, p in cases:
        want = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
        got = spark.range(1).select(quality.binomial_tail(F.lit(k), F.lit(n), p).alias("t")).first()["t"]
        assert abs(got - want) < 1e-9 * max(want, 1e-3)


def test_mixing(docs):
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(ROWS)
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in rows)
    total = sum(r["size"] for r in rows)
    targets = {r["source"]: r["target"] for r in rows}
    assert abs(sum(targets.values()) - total) < 1e-6 * total
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, mixing.mix(docs).collect()), key=str)
    assert mixing.mixed(docs).columns == docs.columns and mixing.mix(docs.limit(0)).count() == 0


def test_packing_round_trip(docs):
    from tokenizers import Tokenizer

    rows = packing.pack(docs, tokenizer_path()).collect()
    tok = Tokenizer.from_file(tokenizer_path())
    for doc_id, text, *_ in ROWS:
        ids = np.asarray([*tok.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        own = [r for r in rows if r["doc_id"] == doc_id]
        assert sum(r["length"] for r in own) == len(ids) * sum(r[0] == doc_id for r in ROWS)
        assert all(zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for r in own)
    by: dict = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack(docs.limit(0), tokenizer_path()).count() == 0


def test_word_tokenizer_is_exact(monkeypatch):
    """Odd characters, and words that return after both generations of the cache are full."""
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "CACHE", 3)
    monkeypatch.setattr(packing, "BLOCK", 5)
    own, tok = packing.WordTokenizer(tokenizer_path()), Tokenizer.from_file(tokenizer_path())
    odd = ["", "  x  ", "A b\u2003c \u0130stanbul \u1e9e \u01c5 \u0085x", "\x1c a\x1db\x00c <|endoftext|> Hi", "don't can't I'M 12,345 a_b 's 't", "\u0958\u0959 abc \u0958, x\u0301y", "\ufb1d\u0915\u093c def", "a<| |> b... (z)!!", "\u02b0a \u00aab \U0001f600 hi\u200d", "\u65e5\u672c \u8a9e", "\u0130, H\u0331 h\u0331, J\u030c. \u03a3\u03a3,"]
    texts = [*odd, " ".join(f"w{chr(97 + i % 26)}x{chr(97 + i % 7)}" for i in range(60)), *odd]
    for text in texts:
        assert own.ids(text) == np.asarray(tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text
    assert own.ids(None) == b""


def test_line_dedup(docs):
    got = {r["doc_id"]: r for r in linedup.line_dedup(docs, min_sites=2).collect()}
    assert got[1]["n_removed"] == 0 and got[2]["n_removed"] == 1 and got[3]["clean_chars"] is None
    assert linedup.without_boilerplate(docs, min_sites=2).columns == docs.columns


def test_line_dedup_of_short_lines(spark):
    rows = [(i, f"All rights reserved.\n\n \nown line number {i} of this text\nLes.", f"s{i}") for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r["text"] for r in linedup.without_boilerplate(docs).collect()}
    assert got[0] == rows[0][1] and all(got[i] == f"\n \nown line number {i} of this text" for i in range(1, 12))
    assert {r["n_removed"] for r in linedup.line_dedup(docs).collect()} == {0, 2}
    assert {r["n_removed"] for r in linedup.line_dedup(docs, least_words=4).collect()} == {0}


def test_line_dedup_joins_when_lines_are_many(spark, docs):
    rows = [(i % 40 if i % 41 else None, "\n".join(f"line {(i * k) % 23} of some" for k in range(9)) + "\n \n", f"s{i % 17}") for i in range(120)]
    many = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for table, sites in ((docs, 2), (many, 10), (many.limit(0), 10)):
        for call in (linedup.line_dedup, linedup.without_boilerplate):
            found, joined = (sorted(map(str, call(table, min_sites=sites, limit=limit).collect())) for limit in (1000, 0))
            assert found == joined


def test_jaccard_brute_force(docs):
    got = {r["doc_id"]: r for r in jaccard.jaccard_components(docs).collect()}
    assert got[2]["component_id"] == 1 and got[12]["component_id"] == 11 and got[4]["component_id"] == 4
    assert got[None]["component_id"] is None and got[11]["n_shingles"] == 1 and got[3]["n_shingles"] == 0
    sets = {k: {tuple(t.split()[i : i + 4]) for i in range(len(t.split()) - 3)} for k, t, *_ in ROWS if k in (7, 8)}
    assert 100 * len(sets[7] & sets[8]) >= 85 * len(sets[7] | sets[8]) and got[8]["component_id"] == 7 and got[7]["n_shingles"] == len(sets[7])
    kept = jaccard.one_of_each(docs).collect()
    assert {r["doc_id"] for r in kept} == {1, 3, 4, 5, None, 6, 7, 9, 10, 11}


def test_compact_windows(docs):
    rows = substring.near_passages(docs).collect()
    assert [(r["doc_id"], r["other_doc_id"]) for r in rows] == [(7, 8)]
    assert rows[0]["start"] <= 2 and rows[0]["end"] >= 62


def _tokens(text: str) -> np.ndarray:
    return substring._tokens(np.frombuffer(text.encode(), np.uint8), np.asarray([0, len(text)]))[0]


def _least(text: str) -> np.ndarray:
    return np.stack([substring.mix(_tokens(text), 20 + k) for k in range(substring.HASHES)])


def _hot_line() -> str:
    """A line of 16 words whose fourth token is low under all hash functions: a pivot with five words of the line on its right."""
    best = []
    for part in range(12):
        words = [f"hot{part}w{i}" for i in range(250_000)]
        v = _least(" ".join(words)).max(0)
        at = 3 + int(v[3:-20].argmin())
        best.append((v[at], " ".join(words[at - 3 : at + 13])))
    return min(best)[1]


def _around(line: str, name: str) -> str:
    """line between 20 words on either side, such that its fourth token is the pivot under all hash functions."""
    for seed in range(20_000):
        text = " ".join([*(f"{name}{seed}l{i}" for i in range(20)), line, *(f"{name}{seed}r{i}" for i in range(20))])
        if (_least(text).argmin(1) == 23).all():
            return text
    raise AssertionError


def test_compact_windows_around_a_frequent_line(spark):
    line = _hot_line()
    shared = _around(line, "shared")
    middle = {d: shared if d in (3, 12) else _around(line, f"own{d}") for d in range(1, 15)}
    rows = [(d, " ".join([*(f"l{d}x{i}" for i in range(40)), m, *(f"r{d}x{i}" for i in range(40))])) for d, m in middle.items()]
    found = substring.near_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["other_doc_id"]) for r in found} == {(3, 12)}
    assert any(r["start"] <= 40 and r["end"] >= 96 for r in found)


@pytest.mark.parametrize("copies", [2, 6, 7, 12, 30])
def test_passages_shared_by_groups_of_any_size(spark, copies):
    """Every document that holds the passage, whole or with a word changed, is in the passage's one class; others that hold its frequent line aren't."""
    rng = np.random.default_rng(copies)
    line = " ".join(f"line{i}" for i in range(12))
    passage = [f"p{i}" for i in range(30)] + line.split() + [f"p{i}" for i in range(30, 60)]
    rows = []
    for i in range(copies):
        own = list(passage)
        if i % 3 == 1:
            own[5 + i % 50] = f"changed{i}"
        rows.append((i, " ".join([f"a{rng.integers(10**6)}" for _ in range(20 + i)] + own + [f"z{rng.integers(10**6)}" for _ in range(15)])))
    rows += [(1000 + i, " ".join([f"b{rng.integers(10**6)}" for _ in range(60)] + line.split() + [f"y{rng.integers(10**6)}" for _ in range(60)])) for i in range(20)]
    found = substring.passage_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"] for r in found} == set(range(copies))
    assert {(r["class_doc_id"]) for r in found} == {0} and all(r["end"] - r["start"] >= 50 and r["links"] >= 1 for r in found)


def test_exact_repeats_against_brute_force(spark):
    rng = np.random.default_rng(5)
    pool = [[f"q{k}x{i}" for i in range(int(rng.integers(50, 90)))] for k in range(6)]
    rows = []
    for i in range(150):
        words = []
        for _ in range(int(rng.integers(1, 4))):
            words += [f"f{x}" for x in rng.integers(0, 40, int(rng.integers(5, 40)))]
            if rng.random() < 0.5:
                words += pool[int(rng.integers(6))]
        rows.append((i, " ".join(words)))
    holders: dict = {}
    for i, text in rows:
        words = text.split()
        for k in range(len(words) - 49):
            holders.setdefault(tuple(words[k : k + 50]), set()).add(i)
    want = {i for at in holders.values() if len(at) > 1 for i in at}
    found = substring.passage_classes(spark.createDataFrame([*rows, (None, rows[0][1]), (900, None), (901, "")], "doc_id long, text string")).collect()
    assert want <= {r["doc_id"] for r in found}
    classes: dict = {}
    for r in found:
        classes.setdefault(r["doc_id"], set()).add((r["class_doc_id"], r["class_start"]))
    assert all(set.intersection(*(classes[i] for i in at)) for at in holders.values() if len(at) > 1)  # no link between two holders is lost
    assert substring.passage_classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_aligned_spans_of_repeated_tokens():
    """An exact passage of 50 words, of which the other side holds five-word phrases also some words before it."""
    passage = np.arange(1, 1 + substring.T, dtype=np.uint64)
    x = np.concatenate([np.arange(1000, 1030, dtype=np.uint64), passage, np.arange(2000, 2030, dtype=np.uint64)])
    for again in ([0], [20], [5, 20, 40]):
        before = np.arange(3000, 3060, dtype=np.uint64)
        before[[(7 * k + 3) % 45 for k in again]] = passage[list(again)]
        y = np.concatenate([before, passage, np.arange(4000, 4030, dtype=np.uint64)])
        found = substring.aligned_spans(x, y)
        assert found is not None and found[0] <= 30 and found[1] >= 80 and found[2] <= 60 and found[3] >= 110, again
    assert substring.aligned_spans(x, np.concatenate([passage[:30], np.arange(5000, 5060, dtype=np.uint64), passage[30:]])) is None


def test_compact_windows_of_a_group_in_steps(spark, monkeypatch):
    """Windows of one pivot, of which two far apart have their context in common."""
    n, chunk = 300, 40
    monkeypatch.setattr(substring, "CHUNK", chunk)
    names = ["k", "v", "doc_id", "l", "c", "r", *[f.split()[0] for f in substring._WINDOW.split(", ")[6:]]]
    context = np.arange(1, n + 1)
    context[250] = context[7]
    cols = {"k": np.zeros(n, np.int32), "v": np.full(n, 5), "doc_id": np.arange(n), **{c: np.full(n, x, np.int32) for c, x in (("l", 0), ("c", 50), ("r", 99))}}
    cols |= {name: context << 32 | context for name in names[6:]}
    batches = [pa.record_batch([pa.array(cols[name][s : s + 30]) for name in names], names) for s in range(0, n, 30)]
    out = pa.Table.from_batches(list(substring._links(iter(batches)))).to_pylist()
    apart = [r for r in out if r.get("b_doc_id") is None]
    assert sorted(r["a_doc_id"] for r in apart) == list(range(n))
    schema = substring._SOME
    far = substring._far(spark.createDataFrame([tuple(r[f.split()[0]] for f in schema.split(", ")) for r in apart], schema)).collect()
    assert {(r["a_doc_id"], r["b_doc_id"]) for r in far} == {(7, 250)} and substring.SURE in {r["k"] for r in far}


def test_language(docs):
    rows = langid.identify(docs).collect()
    got = {r["doc_id"]: r for r in rows}
    assert len(rows) == len(ROWS) and all(0 <= r["score"] <= 1 for r in rows)
    assert all(got[k]["lang_pred"] == "und" for k in (3, 4, 5, 10))


def test_urls(spark):
    urls = [(1, "https://Casino-WIN.example.net/en/1#x"), (2, "http://a.example.org/es/4?q"), (3, None), (4, "nothing"), (5, "http://m.example.com/fr/x"), (6, "http://quiet.example.net/fr/20009")]
    urls += [(100 + i, f"http://site{i % 7}.example.org/en/{i + 20000}") for i in range(300)] + [(500 + i, f"http://casinowin.example.com/de/{i}") for i in range(90)]
    pages = spark.createDataFrame([(i, u, "<p>quiet casino win words here</p>", "x") for i, u in urls], "page_id long, url string, html string, host string")
    got = {r["page_id"]: r for r in urlfilter.judge_urls(pages).collect()}
    assert got[1]["host"] == "casino-win.example.net" and got[1]["path"] == "/en/1" and got[1]["verdict"] == "block"  # its words are those of urls that a rule blocks
    assert got[500]["host_words"][:2] == ["casino", "win"]
    assert (got[2]["rule"], got[2]["verdict"]) == ("example.org/es/", "block") and got[5]["rule"] == "com/fr/"
    assert got[3]["host"] == got[4]["path"] == "" and got[3]["verdict"] == got[6]["verdict"] == "allow"
    assert urlfilter.judge_urls(pages.limit(0)).count() == 0


def _splits(run):
    if not run:
        yield []
    for k in range(1, len(run) + 1):
        for rest in _splits(run[k:]):
            yield [run[:k], *rest]


def test_urls_against_a_plain_version(spark):
    import re
    from collections import Counter

    text = "<p>blog day win casino the ca sino <b>blogs</b></p><script>var hidden=1;</script>"
    rows = [(i, f"http://casino.org/win{i % 7}/x{chr(97 + i % 26)}q" if i % 3 else f"http://blogday-win.com/{'fr' if i % 2 else 'de'}/z{chr(97 + i % 26)}k", text) for i in range(200)]
    rows += [rows[4], (None, None, None), (900, "http://\u00e9t\u00e9blog.net/de/1", None), (901, f"http://{'a' * 70}.net/win", "")]
    got = urlfilter.judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    letters = lambda t: re.findall(r"[^\W\d_]+", t.lower())
    part = re.compile(r"(?s)^.*?://([^/?#]*)([^?#]*)")
    urls = [(i, (m := part.match(u or "")) and m[1].lower() or "", m[2] if m else "") for i, u, _ in rows]
    words = Counter(w for _, _, h in rows if h for w in letters(re.sub(urlfilter._MARKUP, " ", h)))
    words += Counter(w for h in {h for _, h, _ in urls} for label in h.split(".") if "-" in label for w in letters(label))
    words += Counter(w for _, _, p in urls for w in letters(p))
    words = {w: n for w, n in words.items() if 2 <= len(w) <= 63}
    assert "hidden" not in words and "blogs" in words
    total = sum(words.values())
    start = math.log(total + 1) + 1

    def cost(pieces):  # neighbouring unknown pieces would be one
        known = [p in words for p in pieces]
        if any(not a and not b for a, b in zip(known, known[1:], strict=False)):
            return math.inf
        return sum(math.log((total + 1) / words[p]) if k else start + urlfilter.LETTER_COST * len(p) for p, k in zip(pieces, known, strict=True))

    best = {run: [run] if len(run) > 63 else min(_splits(run), key=cost) for run in {r for _, h, _ in urls for r in letters(h)}}

    def tokens(host, path):
        rest = [f"/#{len(t)}" if t[0].isdigit() else f"/{t}" for t in re.findall(r"[^\W\d_]+|[0-9]+", path.lower())]
        return [f"h:{w}" for r in letters(host) for w in best[r]] + rest

    label = {i: r["rule"] and urlfilter.RULES[r["rule"]] for i, r in enumerate(sorted(got, key=lambda r: (str(r["page_id"]), r["path"])))}
    order = sorted(range(len(urls)), key=lambda k: (str(urls[k][0]), urls[k][2]))
    counts = {"block": Counter(), "allow": Counter()}
    for i, k in enumerate(order):
        if label[i]:
            counts[label[i]].update(tokens(*urls[k][1:]))
    docs = Counter(label.values())
    vocabulary = set(counts["block"]) | set(counts["allow"])
    chance = lambda t, c: math.log((counts[c][t] + 1) / (sum(counts[c].values()) + len(vocabulary)))
    for r, k in zip(sorted(got, key=lambda r: (str(r["page_id"]), r["path"])), order, strict=True):
        own = tokens(*urls[k][1:])
        assert [t[2:] for t in own if t.startswith("h:")] == list(r["host_words"])
        want = math.log((docs["block"] + 1) / (docs["allow"] + 1)) + sum(chance(t, "block") - chance(t, "allow") for t in own if t in vocabulary)
        assert abs(want - r["score"]) < 1e-9 and r["verdict"] == (r["rule"] and urlfilter.RULES[r["rule"]] or ("block" if want > 0 else "allow"))


def test_nearest(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 16))
    rows = [(i, [float(v) for v in x[i]]) for i in range(600)] + [(700, None), (720, [0.0] * 16), (740, [float("nan")] * 16), (760, [1.0])]
    got = addq.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    hits = 0
    for q in range(0, 600, 20):
        own = sorted((r["rank"], r["vec_id"]) for r in got if r["query_id"] == q)
        order = [i for i in np.argsort(-(x @ x[q]), kind="stable") if i != q][:20]
        hits += len(set(order) & {v for _, v in own})
        assert len(own) == 20
    assert hits >= 0.9 * 20 * 30 and {r["query_id"] for r in got} == set(range(0, 600, 20))


def test_warc_round_trip_and_salvage(spark):
    big = "<html>" + "x" * 1200
    pages = spark.createDataFrame([(1, "http://a/\r\nb", big), (2, None, big), (3, "http://c", None), (4, "http://d", "é")], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in warc.round_trip(pages).collect()}
    assert (got[1]["record_type"], got[1]["refers_to"], got[2]["record_type"]) == ("revisit", 2, "response")
    assert got[1]["payload_bytes"] == len(big) and got[3]["payload_bytes"] == 0 and got[4]["payload_bytes"] == 2
    members = [warc._member(warc._record(i, None, "00" * 20, 3, None, None)) for i in range(4)]
    whole = list(warc.salvage(b"".join(members)))
    assert [r["kind"] for r in whole] == ["record"] * 4
    torn = members[0] + members[1][:40] + members[2] + b"junk" + members[3]
    found = list(warc.salvage(torn))
    assert [r["kind"] for r in found] == ["record", "gap", "record", "gap", "record"] and found[3]["length"] == 4
    record = [warc._record(i, None, "00" * 20, 3, None, None) for i in range(4)]
    hurt = record[1].replace(b"Content-Length: ", b"Content-Length: 9", 1)
    many = list(warc.salvage(members[0] + warc._member(record[0] + hurt + record[2] + record[3]) + members[1]))
    assert [r["kind"] for r in many] == ["record", "record", "gap", "record", "record", "record"]
    assert many[2]["offset"] == len(members[0]) and f"bytes {len(record[0])} to {len(record[0] + hurt)}" in many[2]["reason"]
    plain = list(warc.salvage(record[0] + hurt + record[2]))
    assert [r["kind"] for r in plain] == ["record", "gap", "record"] and plain[1]["length"] == len(hurt)


def _jaccard_brute(rows, width, percent):
    sets = {}
    for i, text in rows:
        words = (text or "").lower().split()
        sets[i] = {tuple(words[k : k + width]) for k in range(len(words) - width + 1)} if len(words) >= width else {tuple(words)} - {()}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("percent", [50, 85])
def test_jaccard_against_brute_force(spark, monkeypatch, percent):
    rng = np.random.default_rng(percent)
    monkeypatch.setattr(jaccard, "BLOCK", 16)  # so that a shingle in most of the texts needs many blocks
    monkeypatch.setattr(jaccard, "SMALL", 4)
    rows = []
    for i in range(260):
        if i % 3 and rows:
            words = rows[rng.integers(len(rows))][1].split()
            for _ in range(rng.integers(0, 3)):
                words[rng.integers(4, len(words))] = f"n{rng.integers(1000)}"
        else:
            words = ["one", "hot", "run", "here"] + [f"w{x}" for x in rng.integers(0, 60, rng.integers(3, 60))]
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(docs, 4, percent).collect()}
    assert got == _jaccard_brute(rows, 4, percent)


def test_jaccard_refuses_what_it_would_lose(spark):
    with pytest.raises(ValueError):
        jaccard.jaccard_components(spark.createDataFrame([(1, "a b c")], "doc_id long, text string"), 4, 40)
