"""Language identification by multilingual mixture inference (operator 6).

A text is a bag of byte n-grams (n = 1 to 3, A-Z lower-cased, white space runs as one blank), hashed into BUCKETS.
Each language has smoothed n-gram probabilities learned from labelled texts. The proportions of languages in a text are
found by expectation-maximisation over its distinct n-grams. Penalised likelihood alone says which stay (penalty: half a logarithm of the
number of n-grams for each language): first all those of least share go whose loss, by their responsibilities, is known to be no more than
their penalties; texts with several languages left go on to convergence, and lose languages one by one while that does not lower the penalised likelihood.

Defined results: null texts and texts without a letter are `und` with score 0; rows without a language aren't learned
from; with no labelled row at all everything is `und`; ties go to the first language in order; repeated rows are judged
alike. Columns other than those named are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veldspar.llm.common import _LOWER, _SPACE, mix, text_slices

BUCKETS = 1 << 14
#: Labelled documents that the model is fitted on at most (about; a hash of the id selects them).
SAMPLE_DOCS = 50_000
#: Languages a model may hold; more are refused, none is left out.
MAX_LANGS = 512
#: Rounds for all texts; those with several languages left go on in STEPs until no share moves by more than MOVED (or FURTHER rounds have passed: each raises the likelihood).
ROUNDS, STEP, FURTHER, MOVED = 6, 4, 40, 1e-3
#: Likelihoods of overlapping n-grams aren't independent: each counts with this weight in the penalised likelihood.
TEMPER = 0.1


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, bucket) of all texts and how often each occurs."""
    low = np.where(_SPACE[data], np.uint8(32), _LOWER[data])
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    drop = np.zeros(len(low), bool)
    drop[1:] = (low[1:] == 32) & (low[:-1] == 32) & (row[1:] == row[:-1])
    low, row = low[~drop].astype(np.uint64), row[~drop]
    codes, rows = [], []
    code = low
    for n in range(1, 4):
        if n > 1:
            code = (code[: max(0, len(low) - n + 1)] << np.uint64(8)) | low[n - 1 :]
        ok = row[: len(code)] == row[n - 1 :]
        codes.append(((mix(code | np.uint64(n << 40)) & np.uint64(BUCKETS - 1)).astype(np.int64))[ok])
        rows.append(np.searchsorted(row[: len(code)][ok], np.arange(len(offsets))))
    out = []
    for k in range(len(offsets) - 1):
        own = [c[r[k] : r[k + 1]] for c, r in zip(codes, rows, strict=True)]
        found = np.bincount(np.concatenate(own), minlength=BUCKETS)
        at = np.flatnonzero(found)
        out.append((np.full(len(at), k), at, found[at]))
    if not out:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def fit(docs: DataFrame, learn: Column, sample_docs: int = SAMPLE_DOCS, max_langs: int = MAX_LANGS) -> tuple[list[str], np.ndarray]:
    """Languages and their log probabilities (languages x BUCKETS). The sample bounds what is read, max_langs x BUCKETS what reaches the driver."""
    rows = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    total = rows.select("lang").count()
    if total > sample_docs:
        share = int(sample_docs / total * 1_000_000)
        rows = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            langs = b.column(1).to_pylist()
            for i, n, data, offsets in text_slices(b.column(0)):
                row, bucket, c = grams(data, offsets)
                names, which = np.unique(np.asarray(langs[i : i + n], object).astype(str), return_inverse=True)
                both = np.bincount(which[row] * BUCKETS + bucket, c, len(names) * BUCKETS).reshape(len(names), BUCKETS)
                for k, name in enumerate(names):
                    sums[str(name)] = sums.get(str(name), 0) + both[k]
        for name, s in sums.items():
            at = np.flatnonzero(s)
            yield pa.record_batch([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(s[at].astype(np.int64))], ["lang", "bucket", "n"])

    counted = rows.select("text", "lang").mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    lines = counted.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("bucket", "n"))).alias("c"))  # at most BUCKETS each
    top = lines.limit(max_langs + 1).collect()
    if len(top) > max_langs:
        raise ValueError(f"more than {max_langs} languages")
    model = {r["lang"]: r["c"] for r in top}
    langs = sorted(model)
    p = np.full((len(langs), BUCKETS), 0.5)
    for k, name in enumerate(langs):
        for bucket, n in model[name]:
            p[k, bucket] += n
    return langs, np.log(p / p.sum(1, keepdims=True)) if langs else p


class _Mixtures:
    """Texts of one slice: distinct grams (row, bucket, count) and what languages make of them."""

    def __init__(self, logp: np.ndarray, row: np.ndarray, bucket: np.ndarray, count: np.ndarray, n: int):
        like = logp[:, bucket].astype(np.float32)
        self.like = np.exp(like - like.max(0))  # languages x distinct grams; scaled by gram, which the rounds ignore
        self.row, self.bucket, self.count, self.n, self.logp = row, bucket, count, n, logp
        begin = np.searchsorted(row, np.arange(n + 1))
        self.has = begin[1:] > begin[:-1]
        self.total = np.bincount(row, count, n)
        self.penalty = 0.5 * np.log(np.maximum(self.total, 2))
        self.live, self.begin = np.flatnonzero(self.has), begin[:-1][self.has]

    def of(self, rows: np.ndarray) -> _Mixtures:
        new = np.full(self.n, -1)
        new[rows] = np.arange(len(rows))
        own = new[self.row] >= 0
        return _Mixtures(self.logp, new[self.row[own]], self.bucket[own], self.count[own], len(rows))

    def sums(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(x.shape[:-1] + (self.n,))
        if len(self.live):
            out[..., self.live] = np.add.reduceat(x, self.begin, axis=-1)
        return out

    def parts(self, pi: np.ndarray) -> np.ndarray:
        return pi.astype(np.float32)[:, self.row] * self.like

    def rounds(self, pi: np.ndarray, n: int) -> np.ndarray:
        for _ in range(n):
            part = self.parts(pi)
            pi = self.sums(part * (self.count / np.maximum(part.sum(0), np.float32(1e-30))).astype(np.float32)) / np.maximum(self.total, 1)
        return pi

    def converged(self, pi: np.ndarray) -> np.ndarray:
        for _ in range(FURTHER // STEP):
            before, pi = pi, self.rounds(pi, STEP)
            if np.abs(pi - before).max(initial=0) <= MOVED:
                break
        return pi

    def loglik(self, pi: np.ndarray) -> np.ndarray:
        return self.sums(np.log(np.maximum(self.parts(pi).sum(0), np.float32(1e-30))) * self.count)

    def affordable(self, pi: np.ndarray) -> np.ndarray:
        """Which languages stay once the most of least share have gone together whose loss is no more than their penalties. Without them the likelihood of a gram falls by
        their responsibility at most (the others' shares grow, and further rounds only help)."""
        order = pi.argsort(0, kind="stable")
        part = self.parts(pi)
        share = np.take_along_axis(part / np.maximum(part.sum(0), np.float32(1e-30)), order[:, self.row], 0)
        gone = np.cumsum(share, 0, dtype=np.float64)[:-1]
        loss = self.sums(-np.log(np.maximum(1 - gone, 1e-30)) * self.count)
        there = np.cumsum(np.take_along_axis(pi, order, 0) > 0, 0)[:-1]  # what has gone before pays no penalty
        free = TEMPER * loss <= self.penalty * there
        most = np.where(free.any(0), len(free) - free[::-1].argmax(0), 0) if len(free) else np.zeros(self.n, int)
        keep = np.zeros(pi.shape, bool)
        np.put_along_axis(keep, order, np.arange(len(pi))[:, None] >= most, 0)
        return keep


def _scaled(pi: np.ndarray, keep: np.ndarray) -> np.ndarray:
    pi = np.where(keep, np.maximum(pi, 1e-12), 0)
    return pi / pi.sum(0)


def infer(logp: np.ndarray, row: np.ndarray, bucket: np.ndarray, count: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions (n x languages; 0 for languages left out) and whether a row has n-grams."""
    texts = _Mixtures(logp, row, bucket, count, n)
    pi = texts.rounds(np.full((len(logp), n), 1.0 / len(logp), np.float32), ROUNDS)
    keep = texts.affordable(pi)
    pi = _scaled(pi, keep)
    some = np.flatnonzero(keep.sum(0) > 1)
    while len(some):  # texts that may hold several languages, until none loses one
        own = texts.of(some)
        now = own.converged(pi[:, some])
        before = keep[:, some]
        stay = before & own.affordable(np.where(before, now, 0))
        stay |= now == np.where(before, now, -1).max(0)
        trial = before.copy()
        trial[np.where(before, now, np.inf).argmin(0), np.arange(len(some))] = False
        some_gone = (stay != before).any(0)
        trial = np.where(some_gone, stay & before, trial)
        then = own.converged(_scaled(now, trial))
        fewer = before.sum(0) - trial.sum(0)
        better = some_gone | (TEMPER * (own.loglik(then) - own.loglik(now)) + own.penalty * fewer >= 0)
        keep[:, some] = np.where(better, trial, before)
        pi[:, some] = np.where(better, then, now)
        some = some[better & (trial.sum(0) > 1)]
    return np.where(keep, pi, 0), texts.has


def predict(docs: DataFrame, langs: list[str], logp: np.ndarray) -> DataFrame:
    """doc_id, lang_pred, score (the proportion of lang_pred), langs (those selected, with proportions)."""
    table = docs.sparkSession.sparkContext.broadcast(logp.astype(np.float32))  # at most MAX_LANGS x BUCKETS floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            letter = pc.fill_null(pc.match_substring_regex(b.column(1), r"\p{L}"), False).to_numpy(zero_copy_only=False)
            for i, n, data, offsets in text_slices(b.column(1), 1 << 20):
                name, score, mixes = ["und"] * n, np.zeros(n), [[] for _ in range(n)]
                if langs:
                    row, bucket, count = grams(data, offsets)
                    pi, has = infer(table.value, row, bucket, count, n)
                    best = pi.argmax(0)
                    for k in np.flatnonzero(has & letter[i : i + n]):
                        name[k], score[k] = langs[best[k]], min(1.0, float(pi[best[k], k]))
                        mixes[k] = [{"lang": langs[j], "share": float(pi[j, k])} for j in np.flatnonzero(pi[:, k] > 0)]
                kind = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))
                yield pa.record_batch([b.column(0).slice(i, n), pa.array(name), pa.array(score), pa.array(mixes, kind)], ["doc_id", "lang_pred", "score", "langs"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double, langs array<struct<lang:string,share:double>>")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, langs: learned from the rows not held out."""
    langs, logp = fit(docs, ~held_out(F.col("doc_id")))
    return predict(docs, langs, logp).withColumn("held_out", held_out(F.col("doc_id"))).select("doc_id", "held_out", "lang_pred", "score", "langs")
