"""Quality rules with risk-controlled thresholds (operator 5; DataFrame functions only).

Signals of a text reject it beyond a cutoff. A cutoff is chosen per stratum (language) and rule from labelled documents:
walking a fixed grid from lenient to strict, each cutoff is certified by an exact binomial test of "at least alpha of
the good documents are rejected"; the walk stops at the first cutoff that isn't certified (fixed-sequence testing), and
the level is divided over strata and rules (Bonferroni). With probability 1 - delta no stratum loses alpha of its good
documents: each rule gets alpha / rules.

Defined results: null and empty texts have no words and fail the base rule; a null stratum is a stratum of its own;
a stratum with too few labels gets no cutoff and keeps what the base rule keeps; repeated rows are judged alike and a
labelled document counts once; empty tables give empty results; columns beyond those named are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veldspar.llm.common import let, materialise, sized

_BLANK = " \t\n\x0b\f\r"
_BLANKS = r"[ \t\n\x0B\f\r]+"
_SYMBOLS = "[#*$%&|<>]"
WINDOW = 8

#: rule: (signal, cutoffs from lenient to strict). A document is rejected if its signal exceeds the cutoff.
RULES: dict[str, tuple[str, list[float]]] = {
    "symbols": ("n_symbols / word_chars", [0.5, 0.3, 0.2, 0.1, 0.05, 0.02, 0.01, 0.005]),
    "shouting": ("n_bangs / n_words", [2.0, 1.0, 0.5, 0.3, 0.2, 0.1, 0.05]),
    "long_words": ("word_chars / n_words", [14.0, 12.0, 10.0, 9.0, 8.0, 7.5, 7.0]),
    "short_words": ("-word_chars / n_words", [-1.5, -2.0, -2.5, -3.0, -3.5]),
    "dup_lines": ("n_dup_lines / n_lines", [0.9, 0.7, 0.5, 0.4, 0.3, 0.2]),
    "repeats": ("n_repeat_words / n_words", [0.28, 0.25, 0.2, 0.15, 0.1]),
}


def _words(text: Column) -> Column:
    bare = F.btrim(text, F.lit(_BLANK))
    return F.when(F.coalesce(F.length(bare), F.lit(0)) == 0, F.array().cast("array<string>")).otherwise(F.split(bare, _BLANKS))


def _doubled(hashes: Column, width: int) -> Column:
    """Hashes of runs of WINDOW words (a power of two) from hashes of runs of width, doubling; runs past the end are the caller's to cut."""
    if width == WINDOW:
        return hashes
    return let(hashes, lambda h: _doubled(F.zip_with(h, F.slice(h, width + 1, 1 << 30), lambda x, y: F.xxhash64(x, y)), 2 * width))


def _repeat_words(words: Column) -> Column:
    """Words covered by windows of WINDOW words that occur twice or more in the text."""

    def covered(hs: Column) -> Column:
        def positions(ss: Column) -> Column:
            same = lambda a, b: F.get(ss, a)["h"] == F.get(ss, b)["h"]
            dup = F.filter(ss, lambda x, j: F.coalesce(same(j, j - 1), F.lit(False)) | F.coalesce(same(j, j + 1), F.lit(False)))
            return F.sort_array(F.transform(dup, lambda x: x["i"]))

        def cover(ps: Column) -> Column:
            gaps = F.transform(ps, lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get(ps, j + 1) - p, F.lit(WINDOW))).cast("long"))
            return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)

        pairs = F.sort_array(F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hs)) == F.size(hs), F.lit(0).cast("long")).otherwise(let(let(pairs, positions), cover))

    def windows(wh: Column) -> Column:
        return let(F.slice(_doubled(wh, 1), 1, F.size(wh) - (WINDOW - 1)), covered)

    return F.when(F.size(words) < WINDOW, F.lit(0).cast("long")).otherwise(let(F.transform(words, lambda w: F.xxhash64(w)), windows))


def with_signals(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with a struct column __q of the base counts of each whole text."""
    t = F.col(text)
    joined = lambda words: F.length(F.array_join(words, "")).cast("long")

    def counts(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            joined(words).alias("word_chars"),
            F.coalesce(F.regexp_count(t, F.lit(_SYMBOLS)), F.lit(0)).cast("long").alias("n_symbols"),
            F.coalesce(F.regexp_count(t, F.lit("!")), F.lit(0)).cast("long").alias("n_bangs"),
            _repeat_words(words).alias("n_repeat_words"),
        )

    lines = F.filter(F.split(F.coalesce(t, F.lit("")), "\n"), lambda x: F.length(F.btrim(x, F.lit(_BLANK))) > 0)
    line_counts = let(lines, lambda ls: F.struct(F.size(ls).cast("long").alias("n_lines"), (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines")))
    q = docs.withColumn("__w", let(_words(t), counts)).withColumn("__l", line_counts)
    base = (F.col("__w.n_words") < 20) | (100 * F.col("__w.n_repeat_words") > 30 * F.col("__w.n_words"))
    return q.withColumn("__q", F.struct("__w.*", "__l.*", base.alias("base_failed"))).drop("__w", "__l")


def _signal(rule: str) -> Column:
    """The rule's signal from columns of base counts; null (never beyond a cutoff) where its denominator is 0."""
    over, under = RULES[rule][0].split(" / ")
    sign, over = (-1.0, over[1:]) if over[0] == "-" else (1.0, over)
    return F.try_divide(F.col(over).cast("double") * sign, F.col(under).cast("double"))


def _log_gamma(x: Column) -> Column:
    """Stirling's series after a shift by ten."""
    z = x + 10.0
    low = F.lit(0.0)
    for k in range(10):
        low = low + F.log(x + float(k))
    return (z - 0.5) * F.log(z) - z + 0.9189385332046727 + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - low


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X ~ Binomial(n, p), exactly: terms from k down to 0, or to where they no longer count (over ten deviations below)."""
    k, n = k.cast("double"), n.cast("double")
    top = _log_gamma(n + 1) - _log_gamma(k + 1) - _log_gamma(n - k + 1) + k * F.log(F.lit(p)) + (n - k) * F.log(F.lit(1 - p))
    steps = F.least(k, F.ceil(12 * F.sqrt(n) + 60).cast("double")).cast("long")
    zero = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"), F.lit(0.0).alias("i"))

    def step(a: Column, _: Column) -> Column:
        term = a["term"] * ((k - a["i"]) * (1 - p)) / ((n - k + a["i"] + 1) * p)
        return F.struct(term.alias("term"), (a["total"] + term).alias("total"), (a["i"] + 1).alias("i"))

    span = F.when(steps > 0, F.sequence(F.lit(1).cast("long"), steps)).otherwise(F.array().cast("array<bigint>"))
    return F.least(F.lit(1.0), F.exp(top) * F.aggregate(span, zero, step, lambda a: a["total"]))


def certified_cutoffs(labelled: DataFrame, strata: list[str], alpha: float = 0.05, delta: float = 0.05) -> DataFrame:
    """labelled: base counts, strata columns and boolean good, a row per document. Gives a row per stratum: cutoffs map<string,double>."""
    each = alpha / len(RULES)
    good = labelled.where("good")
    total = good.groupBy(*strata).agg(F.count(F.lit(1)).alias("n"))
    sums = [F.count_if(_signal(r) > c).alias(f"{r}_{i}") for r, (_, cs) in RULES.items() for i, c in enumerate(cs)]
    wide = good.groupBy(*strata).agg(F.count(F.lit(1)).alias("n"), *sums)
    cases = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(i).alias("i"), F.lit(float(c)).alias("cutoff"), F.col(f"{r}_{i}").alias("k")) for r, (_, cs) in RULES.items() for i, c in enumerate(cs)])
    m = total.agg((F.count(F.lit(1)) * len(RULES)).alias("m"))
    tests = wide.select(*strata, "n", F.explode(cases).alias("c")).select(*strata, "n", "c.*").join(F.broadcast(m))  # m: one row
    ok = binomial_tail(F.col("k"), F.col("n"), each) <= F.lit(delta) / F.col("m")
    rows = tests.withColumn("ok", ok).groupBy(*strata, "rule").agg(F.min(F.when(~F.col("ok"), F.col("i"))).alias("stop"), F.collect_list(F.struct("i", "cutoff")).alias("cs"))  # at most a grid's cutoffs
    best = F.array_min(F.transform(F.filter("cs", lambda c: F.col("stop").isNull() | (c["i"] < F.col("stop"))), lambda c: c["cutoff"]))
    found = rows.withColumn("best", best).where("best is not null")
    return found.groupBy(*strata).agg(F.map_from_entries(F.collect_list(F.struct("rule", "best"))).alias("cutoffs"))  # at most a row per rule


def fit_cutoffs(signals: DataFrame, labels: DataFrame, strata: list[str], alpha: float = 0.05, delta: float = 0.05) -> DataFrame:
    """signals: doc_id, strata, base counts. labels: doc_id, quality (1 good, 0 not; null rows don't count)."""
    lab = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.max("quality") == 1).alias("good"))
    counts = [c for c in signals.columns if c not in {"doc_id", *strata}]
    both = signals.join(lab, "doc_id").groupBy("doc_id").agg(F.first("good").alias("good"), *[F.first(c).alias(c) for c in [*strata, *counts]])
    return certified_cutoffs(both, strata, alpha, delta)


def judge(signals: DataFrame, cutoffs: DataFrame, strata: list[str]) -> DataFrame:
    """signals with boolean kept: the base rule passes and no signal exceeds its stratum's cutoff."""
    right = sized(cutoffs.select(*[F.col(c).alias(f"__{c}") for c in strata], F.col("cutoffs").alias("__cutoffs")))
    cond = None
    for c in strata:
        same = F.col(c).eqNullSafe(F.col(f"__{c}"))
        cond = same if cond is None else cond & same
    beyond = F.lit(False)
    for r in RULES:
        beyond = beyond | F.coalesce(_signal(r) > F.try_element_at("__cutoffs", F.lit(r)), F.lit(False))
    kept = ~F.col("base_failed") & ~beyond
    return signals.join(right, cond, "left").withColumn("kept", kept).drop("__cutoffs", *[f"__{c}" for c in strata])


def signals_of(docs: DataFrame) -> DataFrame:
    return materialise(with_signals(docs.select("doc_id", "lang", "text")).select("doc_id", "lang", "__q.*"))


def quality_rules(docs: DataFrame, labels: DataFrame, alpha: float = 0.05, delta: float = 0.05) -> DataFrame:
    """A row per document: doc_id, lang, base counts, base_failed, kept."""
    signals = signals_of(docs)
    return judge(signals, materialise(fit_cutoffs(signals, labels, ["lang"], alpha, delta)), ["lang"])


def keep_good(docs: DataFrame, labels: DataFrame, alpha: float = 0.05, delta: float = 0.05) -> DataFrame:
    """The documents kept, with their own columns."""
    own = docs.columns
    rows = with_signals(docs.select("doc_id", F.struct(*own).alias("__doc"), F.col("text"), F.col("lang")))
    rows = materialise(rows.select("doc_id", "__doc", "lang", "__q.*"))  # signals once; the documents go with them, so that nothing has to be joined
    cutoffs = materialise(fit_cutoffs(rows.drop("__doc"), labels, ["lang"], alpha, delta))
    return judge(rows, cutoffs, ["lang"]).where("kept").select("__doc.*")
