"""Packing documents into sequences by non-negative least squares (operator 8).

Documents are tokenised once and cut: whole windows, and a rest. The histogram of piece lengths (at most `window` rows)
goes to the driver, which enumerates shallow combinations of lengths that fill a window (pairs, and triples on a grid),
solves min ||A x - h|| for repeat counts x >= 0 by accelerated projected gradients, rounds them, and packs what is left
by best fit on the histogram. Pieces get a rank within their length (salted, so that no length meets in one task) and
read their sequence and offset from the plan.

Defined results: a null or empty text is the end token alone; repeated rows are packed each for itself; an empty table
gives an empty result; texts of any length are tokenised whole. Columns other than doc_id and text are never read.
"""

from __future__ import annotations

import math
import string
import unicodedata
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veldspar.llm.common import keep, materialise

WINDOW = 2048
END = 1
SALT_ROWS = 4_000
#: Entries of each of the two generations of a worker's cache of word tokens.
CACHE = 250_000
#: Words of a text that are looked up at a time.
BLOCK = 100_000
#: ASCII punctuation but for the apostrophe, whose contractions are tokens of their own.
MARKS = string.punctuation.replace("'", "")

_tokenizers: dict[str, "WordTokenizer"] = {}


def _letters(stem: str) -> bool:
    """Whether a word's stem is letters and stays so when normalised (marks split off would join the punctuation behind it)."""
    return stem.isalpha() and (stem.isascii() or (unicodedata.is_normalized("NFC", stem) and stem.lower().isalpha()))


class WordTokenizer:
    """Token ids of whole texts by the tokenizer file at path, as little-endian unsigned 32-bit ids.

    Its tokens never cross ASCII blanks, so that each blank-separated word is tokenised once and kept. Two generations
    of at most CACHE words (and one block) are kept: words seen again move to the new one, the others go with the old."""

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.last = np.zeros(max(self.tok.get_vocab().values()) + 1, bool)  # ids that end a run of letters or marks
        self.last[[i for t, i in self.tok.get_vocab().items() if t.endswith("</w>")]] = True
        self.words: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.stems: dict[str, bytes] = {}

    def _encode(self, parts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tok.encode_batch_fast(parts, add_special_tokens=False)]

    def _encode_runs(self, parts: list[str]) -> list[bytes]:
        """Runs of letters or of marks are encoded as one text and cut behind the ids that end a run."""
        ids = np.asarray(self.tok.encode_batch_fast([" ".join(parts)], add_special_tokens=False)[0].ids, "<u4")
        ends = (np.flatnonzero(self.last[ids]) + 1) * 4
        if len(ends) != len(parts):  # normalising has split a run
            return self._encode(parts)
        raw, ends = ids.tobytes(), ends.tolist()
        return [raw[i:j] for i, j in zip([0, *ends], ends)]  # noqa: B905

    def _learn(self, block: list[bytes]) -> None:
        """Makes all words of a block known to the new generation."""
        if len(self.words) > CACHE:
            self.words, self.old = {}, self.words
        if len(self.stems) > CACHE:
            self.stems = {}
        words, old, stems = self.words, self.old, self.stems
        unseen = set(block).difference(words)
        missing = unseen.difference(old)
        words.update((w, old[w]) for w in unseen - missing)
        runs, whole, simple = set(), [], []
        for w in missing:
            word = w.decode("utf-8", "replace")
            stem = word.rstrip(MARKS)
            if _letters(stem):
                rest = word[len(stem) :]
                simple.append((w, stem, rest))
                runs.add(stem)
                if rest:
                    runs.add(rest)
            else:
                whole.append((w, word))
        need = [r for r in runs if r not in stems]
        if need:
            stems.update(zip(need, self._encode_runs(need), strict=True))
        for w, stem, rest in simple:
            words[w] = stems[stem] + stems[rest] if rest else stems[stem]
        if whole:
            words.update(zip([w for w, _ in whole], self._encode([word for _, word in whole]), strict=True))

    def ids(self, text: str | None) -> bytes:
        raw = (text or "").encode("utf-8", "replace")
        # case is kept where it tells: in special tokens, and before combining marks (lead bytes CC, CD), which join some small letters only
        kept = b"<|" in raw or b"\xcc" in raw or b"\xcd" in raw
        parts = raw.split() if kept else raw.lower().split()
        try:
            return b"".join(map(self.words.__getitem__, parts))
        except KeyError:
            out = []
            for i in range(0, len(parts), BLOCK):  # a text may hold more words than the cache keeps
                block = parts[i : i + BLOCK]
                self._learn(block)
                out.append(b"".join(map(self.words.__getitem__, block)))
            return b"".join(out)


def tokenizer(path: str) -> WordTokenizer:
    keep("packing", _tokenizers.clear)
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


PIECES = T.StructType([T.StructField("doc_id", T.LongType())] + [T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32", "doc_tokens")])


def pieces(docs: DataFrame, path: str, window: int = WINDOW, end: int = END, with_ids: bool = False) -> DataFrame:
    """Whole windows and the rest of each document: doc_id, start, length, ids_crc32, doc_tokens (and ids, little-endian, if asked)."""
    last = np.asarray([end], "<u4").tobytes()

    def cut(batches):
        tok = tokenizer(path)
        for b in batches:
            rows: list[tuple] = []
            held = 0
            for doc_id, text in zip(b.column(0), b.column(1), strict=True):
                ids = tok.ids(text.as_py()) + last
                n = len(ids) // 4
                for s in range(0, n, window):
                    own = ids[4 * s : 4 * (s + window)]
                    rows.append((doc_id.as_py(), s, len(own) // 4, zlib.crc32(own), n) + ((own,) if with_ids else ()))
                    held += len(own) * with_ids
                if len(rows) > 50_000 or held > 16 << 20:
                    yield batch(rows)
                    rows, held = [], 0
            if rows:
                yield batch(rows)
        tok.old, tok.stems = {}, {}  # the next task begins with the words of this one's last generation

    def batch(rows):
        cols = list(zip(*rows, strict=True))
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids
        return pa.record_batch([pa.array(c, pa.int64() if n != "ids" else pa.binary()) for n, c in zip(names, cols, strict=True)], names)

    schema = T.StructType(PIECES.fields + [T.StructField("ids", T.BinaryType())] * with_ids)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, schema)


def combinations(window: int, grid: int = 64) -> list[tuple[int, ...]]:
    """Shallow combinations that fill the window: all pairs, and triples whose least part lies on a grid."""
    out = [(window - a, a) for a in range(1, window // 2 + 1)]
    step = max(1, window // grid)
    out += [(window - a - b, b, a) for a in range(1, window // 3 + 1, step) for b in range(a, (window - a) // 2 + 1)]
    return out


def nnls_counts(hist: np.ndarray, combos: list[tuple[int, ...]], rounds: int = 300) -> np.ndarray:
    """Repeat counts x >= 0 that minimise ||A x - hist||, A counting the parts of each combination."""
    part = np.concatenate([np.asarray(c) for c in combos])
    of = np.repeat(np.arange(len(combos)), [len(c) for c in combos])
    n = len(hist)
    ax = lambda x: np.bincount(part, x[of], n)
    at = lambda r: np.bincount(of, r[part], len(combos))
    v = np.ones(len(combos))
    for _ in range(20):  # the largest eigenvalue of A'A
        v = at(ax(v))
        lip = np.linalg.norm(v)
        v /= lip
    x = y = np.zeros(len(combos))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - at(ax(y) - hist) / (1.05 * lip))
        t, was = (1 + math.sqrt(1 + 4 * t * t)) / 2, t
        y = new + (was - 1) / t * (new - x)
        x = new
    return x


def pack_histogram(hist: np.ndarray, window: int = WINDOW) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, repeats) that use each length as often as hist (index: length) says."""
    left = hist.astype(np.int64).copy()
    plan = [((window,), int(left[window]))] if left[window] else []
    left[window] = 0
    combos = combinations(window)
    if left.sum():
        x = nnls_counts(left.astype(float), combos)
        for i in np.argsort(-x, kind="stable"):
            want = int(x[i] + 0.5)
            if want < 1:
                break
            lengths, times = np.unique(combos[i], return_counts=True)
            k = min(want, int((left[lengths] // times).min()))
            if k:
                plan.append((combos[i], k))
                left[lengths] -= k * times
    # best fit, longest first, on the histogram: room -> patterns with that much room
    room: dict[int, list[list]] = {}
    free = np.zeros(window + 1, np.int64)
    for length in range(window, 0, -1):
        count = int(left[length])
        while count:
            fit = np.flatnonzero(free[length:])
            if not len(fit):
                room.setdefault(window - length, []).append([(length,), count])
                free[window - length] += count
                break
            r = length + int(fit[0])
            lengths, k = room[r][-1]
            take = min(k, count)
            room[r][-1][1] -= take
            if room[r][-1][1] == 0:
                room[r].pop()
            free[r] -= take
            room.setdefault(r - length, []).append([(*lengths, length), take])
            free[r - length] += take
            count -= take
    return plan + [(tuple(lengths), k) for found in room.values() for lengths, k in found if k]


def _slots(spark: SparkSession, plan: list[tuple[tuple[int, ...], int]]) -> DataFrame:
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for lengths, k in plan:
        offset = 0
        for length in lengths:
            lo = used.get(length, 0)
            used[length] = lo + k
            rows.append((length, lo, lo + k, sequence, offset))
            offset += length
        sequence += k
    return spark.createDataFrame(rows, "slot_length long, lo long, hi long, first long, offset long")


def pack(docs: DataFrame, path: str, window: int = WINDOW, end: int = END, with_ids: bool = False) -> DataFrame:
    """Every piece with its place: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    cut = materialise(pieces(docs, path, window, end, with_ids))
    counts = cut.groupBy("length").count().collect()  # at most `window` rows
    hist = np.zeros(window + 1, np.int64)
    for length, n in counts:
        hist[length] = n
    slots = _slots(spark, pack_histogram(hist, window))  # its size depends on the window alone
    salts = spark.createDataFrame([(int(n), int(-(-k // SALT_ROWS))) for n, k in enumerate(hist) if k], "salt_length long, salts long")
    hashed = F.xxhash64("doc_id", "start", "ids_crc32")
    rows = cut.join(F.broadcast(salts), F.col("length") == F.col("salt_length")).withColumn("salt", F.pmod(hashed, F.col("salts"))).drop("salt_length", "salts")
    ranked = rows.withColumn("at", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32")).cast("long") - 1)
    sums = rows.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    sums = sums.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).drop("n")
    ranked = ranked.join(sums, ["length", "salt"]).withColumn("rank", F.col("at") + F.col("before"))
    placed = ranked.join(F.broadcast(slots), (F.col("length") == F.col("slot_length")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("first") + F.col("rank") - F.col("lo")).alias("sequence_id"), "offset", *["ids"] * with_ids)
