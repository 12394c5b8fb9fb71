"""SimHash components, Merkle manifests and hard negatives against brute force, and their edge cases."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from veldspar.llm import hardneg, merkle, simhash
from tests.llm.test_operators import ROWS, SCHEMA

SCRAP = "doc_id long, text string, lang string, source string, n_chars long, key string, cell long, row long, g string"


@pytest.fixture(scope="module")
def docs(spark):
    """Columns whose names clash with those that the operators use."""
    rows = [(*r, 5, "k", 1, 2, "g") for r in ROWS]
    return spark.createDataFrame(rows, SCRAP)


def _roots(n, pairs):
    up = list(range(n))

    def find(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for a, b in pairs:
        up[find(a)] = find(b)
    return [find(i) for i in range(n)]


def _words(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def _plain_fingerprint(text, width=3):
    words = _words(text)
    runs = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64(r.encode(), seed=42).intdigest() for r in runs]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


# --- SimHash -----------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("piece", [3, 7, 64, 1 << 20])
def test_fingerprint_in_pieces(monkeypatch, piece):
    monkeypatch.setattr(simhash, "PIECE", piece)
    texts = ["", " \n", "One", "one TWO", "ÉLAN vital a b c\x1cd\x0be f", "a b c d e f g a b c", "x" * 50, " lead and  trail \t end\n", "tab\tnew\nline\rreturn\x0bvt\x0cff end"]
    for t in texts:
        assert simhash.fingerprint(t.encode()) == _plain_fingerprint(t), t


def test_fingerprint_is_what_spark_hashes(spark):
    """A shingle's hash equals Spark's own xxhash64, whose seed is 42."""
    t = "straße und Übermut heute"
    got = spark.createDataFrame([(t,)], "t string").selectExpr("xxhash64(t) AS h").first()["h"]
    assert got % 2**64 == xxhash.xxh64(t.encode(), seed=simhash.SEED).intdigest()


def test_embedding_bounds_the_distance(spark):
    rng = random.Random(3)
    fps = [0, 2**64 - 1, 1 << 63, *(rng.getrandbits(64) for _ in range(20))]
    rows = spark.createDataFrame([(f - 2**64 if f >> 63 else f,) for f in fps], "fp long")
    points = [r["p"] for r in rows.select(simhash.embedded(rows.fp).alias("p")).collect()]
    counts = [[p >> 4 * i & 15 for i in range(16)] for p in points]
    assert counts == [[(f >> 4 * i & 15).bit_count() for i in range(16)] for f in fps]


@pytest.mark.parametrize("crowd", [2, 8, 64])
def test_links_connect_all_close_fingerprints(spark, monkeypatch, crowd):
    monkeypatch.setattr(simhash, "CROWD", crowd)
    rng = random.Random(crowd)
    fps = {0, 2**64 - 1, 3, 12}
    for centre in (rng.getrandbits(64), rng.getrandbits(64) | 1 << 63, 0):
        for _ in range(60):
            f = centre
            for _ in range(rng.randrange(6)):
                f ^= 1 << rng.randrange(64)
            fps.add(f)
    fps = sorted(fps)
    signed = [f - 2**64 if f >> 63 else f for f in fps]
    got = simhash.links(spark.createDataFrame([(s,) for s in signed], "fp long")).collect()
    at = {s: i for i, s in enumerate(signed)}
    pairs = {(min(at[r["u"]], at[r["v"]]), max(at[r["u"]], at[r["v"]])) for r in got}
    near = {(i, j) for j in range(len(fps)) for i in range(j) if (fps[i] ^ fps[j]).bit_count() <= 2}
    assert pairs <= near
    if crowd == 64:
        assert len(near) > 100

    def groups(p):
        roots = _roots(len(fps), p)
        out = defaultdict(list)
        for i, r in enumerate(roots):
            out[r].append(i)
        return sorted(out.values())

    assert groups(pairs) == groups(near)


def test_simhash_of_awkward_documents(spark, docs):
    got = simhash.near_duplicates(docs).collect()
    rows = [(r[0], r[1]) for r in ROWS]
    fps = [_plain_fingerprint(t) for _, t in rows]
    roots = _roots(len(rows), [(i, j) for j in range(len(rows)) for i in range(j) if (fps[i] ^ fps[j]).bit_count() <= 2])
    least = {r: min((rows[i][0] for i in range(len(rows)) if roots[i] == r and rows[i][0] is not None), default=None) for r in roots}
    want = sorted(((rows[i][0], f"{fps[i]:016x}", least[roots[i]]) for i in range(len(rows))), key=str)
    assert sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got), key=str) == want
    assert {r["component_id"] for r in got if r["doc_id"] in (3, 4, 5)} == {3}  # null, empty and wordless texts
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


# --- Merkle manifest ---------------------------------------------------------------------------------------------


def _h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _leaf(doc_id, source, lang, n_chars, text):
    return _h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def _plain_manifest(rows):
    """rows: doc_id, text, lang, source, n_chars. doc_id, leaf, subroot, root, proof_sha256, folded_root of each."""

    def climb(digests):
        """Root, and the siblings left and right of every step for each digest."""
        steps, level, where = [[] for _ in digests], list(digests), list(range(len(digests)))
        while len(level) > 1:
            for i, at in enumerate(where):
                run = at - at % 8
                steps[i].append(("".join(level[run:at]), "".join(level[at + 1 : run + 8])))
            level = [_h(*level[i : i + 8]) for i in range(0, len(level), 8)]
            where = [at // 8 for at in where]
        return level[0], steps

    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append((r, _leaf(r[0], r[3], r[2], r[4], r[1])))
    langs = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in langs:
        groups[g].sort(key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
    subs = {g: climb([leaf for _, leaf in groups[g]]) for g in langs}
    root, tops = climb([subs[g][0] for g in langs])
    out = []
    for g, top in zip(langs, tops, strict=True):
        for (r, leaf), steps in zip(groups[g], subs[g][1], strict=True):
            now = leaf
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0:
                text = None if r[1] is None else re.sub("[A-Z]", lambda m: m[0].lower(), r[1])
                now = _leaf(r[0], r[3], r[2], r[4], text)
            for left, right in steps + top:
                now = _h(left, now, right)
            out.append((r[0], leaf, subs[g][0], root, _h(*(s for step in steps + top for s in step)), now, now == root))
    return sorted(out, key=str)


def _manifest(rows):
    return sorted(((r["doc_id"], r["leaf"], r["subroot"], r["root"], r["proof_sha256"], r["folded_root"], r["verified"]) for r in merkle.manifest(rows).collect()), key=str)


@pytest.mark.parametrize("bucket", [3, 16_384])
def test_manifest_against_a_plain_tree(spark, monkeypatch, bucket):
    monkeypatch.setattr(merkle, "BUCKET", bucket)
    rng = random.Random(bucket)
    langs = [None, "", "en", "é", "z", "\U0001f600", "￿", *(f"l{i}" for i in range(12))]
    rows = [(rng.choice([rng.randrange(200), rng.randrange(-(2**63), 2**63), None]), rng.choice(["Text A", "b", None, ""]), "en" if rng.random() < 0.5 else rng.choice(langs), rng.choice(["s", None]), rng.choice([1, None])) for _ in range(400)]
    rows += [(7, "Copy", "fr", "s", 1)] * 30 + [(7, f"Other {i}", "fr", "s", 1) for i in range(30)]
    got = _manifest(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3))
    assert got == _plain_manifest(rows)
    assert not all(r[-1] for r in got) and any(r[-1] for r in got)


@pytest.mark.parametrize("n", [1, 2, 8, 9, 64, 65])
def test_manifest_of_few_rows(spark, n):
    rows = [(i * 1000, f"Text {i}", "en", None, i) for i in range(n)]
    got = _manifest(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))
    assert got == _plain_manifest(rows)
    if n == 1:
        assert got[0][4] == _h() and got[0][1] == got[0][2] == got[0][3]


def test_manifest_of_awkward_documents(spark, docs):
    assert _manifest(docs) == _plain_manifest([(r[0], r[1], r[2], r[3], 5) for r in ROWS])
    assert _manifest(docs.limit(0)) == []


# --- hard negatives ----------------------------------------------------------------------------------------------


def _plain_negatives(rows, every=50, positives=5, negatives=3):
    kept = []
    for vec_id, v, label in rows:
        if vec_id is None or label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        q = [int(np.floor(np.float64(np.float32(x)) * 256)) for x in v]
        kept.append((vec_id, q, int(np.fmod(label + 1, 10)) if vec_id % 7 == 0 else label))
    out = []
    for i, (anchor, q, label) in enumerate(kept):
        if anchor % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(q, p, strict=True)), other, k) for k, (other, p, _) in enumerate(kept) if k != i and len(p) == len(q))
        for s, positive, _ in [x for x in scored if kept[x[2]][2] == label][:positives]:
            between = [x for x in scored if kept[x[2]][2] != label and 50 * -s <= 100 * -x[0] <= 95 * -s][:negatives]
            out += [(anchor, positive, r + 1, other, -s, -t) for r, (t, other, _) in enumerate(between)]
    return sorted(out)


def _mined(spark, rows, **kw):
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "vec_id long, embedding array<float>, label int, row int, block int, d int")
    return sorted(tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in hardneg.mine(df, **kw).collect())


@pytest.mark.parametrize("block", [(3, 5), (4_096, 65_536)])
def test_negatives_against_a_full_sort(spark, monkeypatch, block):
    monkeypatch.setattr(hardneg, "BLOCK_ROWS", block)
    monkeypatch.setattr(hardneg, "SCORES", 40)
    rng = np.random.default_rng(block[0])
    rows = [(int(i), [float(x) for x in rng.normal(size=4).round(1)], int(rng.integers(0, 3))) for i in rng.permutation(150)]
    rows += [(10 + i, [0.5, 0.5, 0.5, 0.5], i % 3) for i in range(20)]  # ties and repeated ids
    rows += [rows[3]] * 3 + [(50, [0.1, 0.2], 1), (51, [0.1, 0.3], 1), (52, [0.1, 0.15], 2), (60, [], 1), (100, [], 1), (70, [], 2)]  # repeated rows, other lengths
    rows += [(200, None, 1), (250, [1.0, None, 0.0, 0.0], 1), (300, [float("nan")] * 4, 1), (350, [float("inf")] * 4, 1), (400, [1.0] * 4, None), (None, [1.0] * 4, 1)]
    rows += [(450, [0.0] * 4, 0), (451, [0.0] * 4, 0), (500, [-1.0, -1.0, -1.0, -1.0], 1)]
    assert _mined(spark, rows) == _plain_negatives(rows)
    assert _mined(spark, rows, every=9, positives=2, negatives=1) == _plain_negatives(rows, 9, 2, 1)


def test_negatives_of_odd_tables(spark):
    assert _mined(spark, []) == [] and _mined(spark, [(0, [1.0], 1)]) == [] and _mined(spark, [(0, [1.0], 1), (1, [1.0], 2)]) == []
    big = [(0, [1e30, 0.0], 1), (50, [1e6, 1.0], 1), (51, [1e6, 2.0], 1), (52, [7e5, 2.0], 2)]
    got = _mined(spark, big)
    assert got == _plain_negatives(big[1:]) and len(got) == 1  # the first is out of range
