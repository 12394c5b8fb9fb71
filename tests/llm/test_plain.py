"""Operators that SQL can't express, against plain versions."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np

from veldspar.llm import langid, mixing, quality


def _counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    spots: dict = {}
    for i in range(len(words) - 7):
        spots.setdefault(tuple(words[i : i + 8]), []).append(i)
    repeat = len({p + k for at in spots.values() if len(at) > 1 for p in at for k in range(8)})
    n = len(words)
    return {
        "n_words": n, "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text or "")), "n_bangs": (text or "").count("!"), "n_lines": len(lines),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": repeat, "base_failed": n < 20 or 100 * repeat > 30 * n,
    }


def _texts(rng, n):
    pool = ["a", "bb", "#x", "word", "éa", "!!", "long" * 5, "c d", "$", "\U0001f600"]
    out = []
    for i in range(n):
        words = [pool[k] for k in rng.integers(0, len(pool) if i % 3 else 4, int(rng.integers(0, 120)))]
        seps = [" ", "\n", " \t", "\r\n", "\x0b"]
        text = "".join(w + seps[int(rng.integers(5)) if rng.random() < 0.3 else 0] for w in words)
        out.append(text + (text[: len(text) // 2] if i % 5 == 0 else ""))
    return [*out, None, "", " \n "]


def test_quality_against_a_plain_version(spark):
    rng = np.random.default_rng(1)
    rows = [(i, t, ["en", "fr", None][i % 3]) for i, t in enumerate(_texts(rng, 900))]
    labels = [(i, int(rng.random() < 0.9)) for i in range(0, 900, 1)]
    got = {r["doc_id"]: r for r in quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int"), 0.3, 0.2).collect()}
    counts = {i: _counts(t) for i, t, _ in rows}
    for i, c in counts.items():
        assert {k: got[i][k] for k in c} == c, i
    good = dict(labels)

    def signal(c, rule):
        over, under = quality.RULES[rule][0].split(" / ")
        return None if c[under] == 0 else c[over.lstrip("-")] / c[under] * (-1 if over[0] == "-" else 1)

    strata = {lang: [counts[i] for i, _, x in rows if x == lang and good.get(i)] for lang in ("en", "fr", None)}
    each, cut = 0.3 / len(quality.RULES), {}
    for lang, own in strata.items():
        for rule, (_, cutoffs) in quality.RULES.items():
            for c in cutoffs:
                k = sum((s := signal(x, rule)) is not None and s > c for x in own)
                tail = sum(math.comb(len(own), j) * each**j * (1 - each) ** (len(own) - j) for j in range(k + 1))
                if tail > 0.2 / (len(strata) * len(quality.RULES)):
                    break
                cut[lang, rule] = c
    assert cut  # some cutoff is certified
    for i, _, lang in rows:
        beyond = any((lang, r) in cut and (s := signal(counts[i], r)) is not None and s > cut[lang, r] for r in quality.RULES)
        assert got[i]["kept"] == (not counts[i]["base_failed"] and not beyond), i


def test_mixing_against_a_plain_version(spark):
    rng = np.random.default_rng(2)
    shares = {"a": 300, "b": 20, "c": 90, "é": 8, None: 40}
    rows = [(int(i), " ".join(["w"] * int(rng.integers(0, 60)) * (1 if i % 7 else 5)), s) for s, n in shares.items() for i in rng.choice(10**6, n, replace=False)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    again = mixing.mix(spark.createDataFrame(rows[::-1], "doc_id long, text string, source string").repartition(5)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(t.split())
    order = [*sorted(k for k in sizes if k is not None), None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, free, rest = {}, set(order), float(sum(sizes.values()))
    while True:  # what stops at three times its size leaves; the others share the rest by weight
        own = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        full = {s for s in free if own[s] > 3 * sizes[s]}
        if not full:
            target |= own
            break
        target |= {s: 3.0 * sizes[s] for s in full}
        rest -= sum(3.0 * sizes[s] for s in full)
        free -= full
    taken, longest = Counter(), Counter()
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - target[r["source"]]) < 1e-6 * max(1, target[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] % max(r["size"], 1) == 0
        taken[r["source"]] += r["taken"]
        longest[r["source"]] = max(longest[r["source"]], r["size"])
    assert all(abs(taken[s] - target[s]) <= longest[s] for s in order)
    # rates are tilted exponentially by size: within a source the mean rate moves one way with the size
    by = {s: sorted((r["size"], r["copies"]) for r in got if r["source"] == s and r["size"]) for s in ("a", "c")}
    for s, pairs in by.items():
        third = len(pairs) // 3
        low, high = (np.mean([c for _, c in part]) for part in (pairs[:third], pairs[-third:]))
        assert (high < low + 0.25) if target[s] < sizes[s] else (high > low - 0.25)


def test_languages_held_out_and_mixed(spark):
    rng = np.random.default_rng(3)
    letters = {"xx": "abcdefgh", "yy": "ghijklmn", "zz": "nopqrstu"}
    text = lambda lang, n: " ".join("".join(rng.choice(list(letters[lang]), int(rng.integers(2, 8)))) for _ in range(n))
    rows = [(i, text(lang, 40), lang) for i in range(300) for lang in [["xx", "yy", "zz"][i % 3]]]
    rows += [(1000, text("xx", 60) + " " + text("zz", 40), None), (1001, None, "xx"), (1002, "123 !!", "yy"), (1003, "", None)]
    got = {r["doc_id"]: r for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    held = [(i, lang) for i, _, lang in rows if i < 300 and got[i]["held_out"]]
    assert 40 < len(held) < 110 and all(got[i]["lang_pred"] == lang for i, lang in held)
    mixed = {x["lang"]: x["share"] for x in got[1000]["langs"]}
    assert set(mixed) == {"xx", "zz"} and abs(mixed["xx"] - 0.6) < 0.1 and got[1000]["lang_pred"] == "xx"
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (1001, 1002, 1003))
