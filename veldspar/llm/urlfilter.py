"""URL filters: rules, then host word segmentation with naive Bayes (operator 3).

Rules (host, path prefix) decide first; the longest that fits wins. The urls that rules decide are also what is learned from: the letters
of a host are split into words by unigram Viterbi, path tokens are added, and multinomial naive Bayes compares "block" with "allow".
Word frequencies are those of the pages' own text, of hyphenated host labels and of paths. Counts of words and tokens stay tables: the
words that a host may hold reach it by a join on its substrings, log ratios reach hosts and paths by a join on the token.

Defined results: a null url or one without "://" has an empty host and path, fits no rule and has no tokens, so that the prior decides
(allow if the prior is even); tokens that no rule-decided url holds tell nothing; a run of letters longer than a host label may be (63) is one
word; repeated rows are judged alike; an empty table gives an empty result. Columns other than page_id, url and html are never read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veldspar.llm.common import materialise, sized

#: The fixed rules: rule text (host and path prefix) -> verdict.
RULES = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}
#: Longest label of a host name (a fixed value of the domain name system).
LABEL = 63
#: Cost of an unknown piece of a host, beyond that of the least frequent word, for each letter.
LETTER_COST = 5.0
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_MARKUP = r"(?is)<(script|style)\b.*?</\1\s*>|<[^>]*>"
_NO_STRINGS = "array<string>"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _UPPER.lower()), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest rule that fits, or null."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):  # the last fit overrides
        own, slash, rest = rule.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(slash + rest)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def _explode_letters(text: Column) -> Column:
    return F.explode(F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+"), F.lit(0)))


def word_counts(pages: DataFrame, urls: DataFrame) -> DataFrame:
    """w, n: words of two letters and more of the pages' text, of the parts of hyphenated labels and of the paths. Nothing is left out."""
    prose = pages.where("html is not null").select(_explode_letters(F.regexp_replace("html", _MARKUP, " ")).alias("w"))
    labels = urls.select("host").distinct().select(F.explode(F.split("host", r"\.")).alias("label")).where("label like '%-%'").select(_explode_letters(F.col("label")).alias("w"))
    paths = urls.select(_explode_letters(F.col("path")).alias("w"))
    words = prose.unionByName(labels).unionByName(paths).where(F.length("w").between(2, LABEL))
    return words.groupBy("w").agg(F.count(F.lit(1)).alias("n"))


def segment(run: str, words: dict[str, int], total: int) -> list[str]:
    """Unigram Viterbi: the split of a run of letters with the highest product of word probabilities; unknown pieces cost by their length.

    known[j] and open[j]: least cost of the first j letters, the last piece a known word or an unknown piece that may go on."""
    if len(run) > LABEL:
        return [run]
    start = math.log(total + 1) + 1
    cost = {w: math.log((total + 1) / n) for w, n in words.items()}
    lengths = sorted({len(w) for w in words})
    known, open_ = [(0.0, 0)], [(math.inf, 0)]
    for j in range(1, len(run) + 1):
        fits = [(min(known[j - k][0], open_[j - k][0]) + cost[run[j - k : j]], k) for k in lengths if k <= j and run[j - k : j] in cost]
        known.append(min(fits, default=(math.inf, 0)))
        open_.append(min((open_[j - 1][0] + LETTER_COST, open_[j - 1][1] + 1), (known[j - 1][0] + start + LETTER_COST, 1)))
    out, j = [], len(run)
    while j:
        k = known[j][1] if known[j][0] <= open_[j][0] else open_[j][1]
        out.append(run[j - k : j])
        j -= k
    return out[::-1]


def segmented_hosts(urls: DataFrame, words: DataFrame) -> DataFrame:
    """host, words: a row per distinct host. A run of letters meets the words it may hold by a join on its substrings (at most 63 * 62 / 2)."""
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    runs_of = F.regexp_extract_all(F.col("host"), F.lit(r"\p{L}+"), F.lit(0))
    hosts = urls.select("host").distinct().select("host", F.posexplode(runs_of).alias("pos", "run"))
    runs = hosts.select("run").distinct()
    n = F.length("run")
    ends = lambda i: F.sequence(i + 1, n)
    pieces = F.flatten(F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.transform(ends(i), lambda j: F.substring("run", i, j - i + 1))))
    held = runs.where(n.between(2, LABEL)).select("run", F.explode(F.array_distinct(pieces)).alias("w")).join(words, "w")
    found = held.groupBy("run").agg(F.collect_list(F.struct("w", "n")).alias("held"))  # at most a run's substrings
    rows = runs.join(found, "run", "left")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            runs = b.column("run").to_pylist()
            own = [segment(r, {x["w"]: x["n"] for x in h or []}, total) for r, h in zip(runs, b.column("held").to_pylist(), strict=True)]
            yield pa.record_batch([pa.array(runs, pa.string()), pa.array(own, pa.list_(pa.string()))], ["run", "words"])

    split_runs = rows.mapInArrow(split, "run string, words array<string>")
    joined = hosts.join(split_runs, "run").groupBy("host").agg(F.sort_array(F.collect_list(F.struct("pos", "words"))).alias("parts"))  # at most a host's runs
    return materialise(joined.select("host", F.flatten(F.transform("parts", lambda x: x["words"])).alias("words")))


def path_tokens(path: Column) -> Column:
    """Runs of letters and of digits (a number by how many digits it has)."""
    runs = F.regexp_extract_all(F.lower(path), F.lit(r"\p{L}+|[0-9]+"), F.lit(0))
    return F.transform(runs, lambda t: F.when(t.rlike("^[0-9]"), F.concat(F.lit("/#"), F.length(t).cast("string"))).otherwise(F.concat(F.lit("/"), t)))


def learn(urls: DataFrame, hosts: DataFrame, smooth: float = 1.0) -> tuple[DataFrame, float]:
    """urls: host, path, label (block, allow or null). token, ratio (log likelihood ratio block/allow) of every token of labelled urls, and the prior's."""
    of = lambda name: F.count_if(F.col("label") == name).alias(name)
    known = urls.where("label is not null")
    by_host = known.groupBy("host").agg(of("block"), of("allow")).join(sized(hosts), "host").select(F.explode("words").alias("t"), "block", "allow")
    by_path = known.groupBy("path").agg(of("block"), of("allow")).select(F.explode(path_tokens(F.col("path"))).alias("token"), "block", "allow")
    tokens = by_host.select(F.concat(F.lit("h:"), "t").alias("token"), "block", "allow").unionByName(by_path)
    counts = materialise(tokens.groupBy("token").agg(F.sum("block").alias("block"), F.sum("allow").alias("allow")))
    size, block, allow = counts.agg(F.count(F.lit(1)), F.coalesce(F.sum("block"), F.lit(0)), F.coalesce(F.sum("allow"), F.lit(0))).first()
    docs = known.agg(of("block"), of("allow")).first()
    ratio = F.log((F.col("block") + smooth) / (block + smooth * size)) - F.log((F.col("allow") + smooth) / (allow + smooth * size))
    return counts.select("token", ratio.alias("ratio")), math.log((docs["block"] + 1) / (docs["allow"] + 1))


def scored(urls: DataFrame, hosts: DataFrame, ratios: DataFrame, prior: float) -> DataFrame:
    """urls with host_words and score (log odds of block). Ratios meet each distinct host and path once."""
    ratios = sized(ratios)
    tokens = hosts.select("host", F.explode("words").alias("t")).select("host", F.concat(F.lit("h:"), "t").alias("token"))
    host_score = tokens.join(ratios, "token").groupBy("host").agg(F.sum("ratio").alias("host_score"))
    by_host = materialise(hosts.join(host_score, "host", "left").select("host", F.col("words").alias("host_words"), "host_score"))
    tokens = urls.select("path").distinct().select("path", F.explode(path_tokens(F.col("path"))).alias("token"))
    by_path = materialise(tokens.join(ratios, "token").groupBy("path").agg(F.sum("ratio").alias("path_score")))
    rows = urls.join(sized(by_host), "host", "left").join(sized(by_path), "path", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    rows = rows.withColumn("score", zero("host_score") + zero("path_score") + F.lit(prior)).withColumn("host_words", F.coalesce("host_words", F.array().cast(_NO_STRINGS)))
    return rows.select(*urls.columns, "host_words", "score")


def _urls(pages: DataFrame, rules: dict[str, str]) -> DataFrame:
    rows = pages.select(F.col("page_id").cast("long"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rows = rows.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    return materialise(rows.withColumn("label", F.try_element_at(F.create_map(*[F.lit(x) for kv in rules.items() for x in kv]), "rule")))


def judge_urls(pages: DataFrame, rules: dict[str, str] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, score (log odds of block), host_words."""
    urls = _urls(pages, rules)
    hosts = segmented_hosts(urls, materialise(word_counts(pages, urls)))
    rows = scored(urls, hosts, *learn(urls, hosts))
    verdict = F.coalesce("label", F.when(F.col("score") > 0, "block").otherwise("allow"))
    return rows.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score", "host_words")


def held_out_accuracy(pages: DataFrame, rules: dict[str, str] = RULES, folds: int = 5) -> dict[str, int]:
    """Of the urls that rules decide, one fold (by host and path) is judged by what the others teach: right and wrong verdicts of either class."""
    urls = _urls(pages, rules)
    hosts = segmented_hosts(urls, materialise(word_counts(pages, urls)))
    out = F.pmod(F.xxhash64("host", "path"), F.lit(folds)) == 0
    own = learn(urls.withColumn("label", F.when(~out, F.col("label"))), hosts)
    said = F.when(F.col("score") > 0, "block").otherwise("allow")
    rows = scored(urls.where(out & F.col("label").isNotNull()), hosts, *own).groupBy("label").agg(F.count_if(said == F.col("label")).alias("right"), F.count_if(said != F.col("label")).alias("wrong"))
    return {f"{r['label']}_{k}": r[k] for r in rows.collect() for k in ("right", "wrong")}
