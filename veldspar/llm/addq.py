"""Approximate nearest neighbours by additive quantisation (operator 4).

A vector is approximated by a sum of full-dimensional codewords, one from each codebook. Codebooks start from residual
k-means on a bounded sample and are refitted by least squares, book after book; every vector is encoded by beam search, and the norm
of its approximation and that of what it leaves are stored. A query scores codes by lookup tables (inner products with codewords); the best of
each part of the index are scored exactly on the original vectors, in double precision. The stored norms bound how far a lookup score may be
from the true one, so that whatever could still reach the k-th exact score is scored exactly too: no near vector of a part is lost.

The first codebook is a coarse quantiser: a part is sorted by first codeword, and of each such cell the largest distance of a member from the codeword is known. A query looks
at the cells with the highest bounds first (inner product with the codeword, plus its own norm times that distance); once it has a k-th exact
score, cells whose bound is below it are skipped whole, exactly. Queries go through a part some at a time: their lookup scores are one matrix product with the
approximations that the codes stand for, and another one, of 32-bit copies of the vectors, checks what the bounds leave before the exact scores.

Defined results: null or zero vectors and those with null or non-finite components take no part; vectors of another length than the query's
are no candidates of it; ties go to the smaller id; every row counts for itself, so that rows of one repeated id are queries each with an answer of its own, and
candidates of each other; an empty table gives an empty result. Columns other than vec_id and embedding are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veldspar.llm.common import materialise

BOOKS, WORDS, BEAM = 16, 256, 4
#: Vectors that the codebooks are fitted on, at most about; all vectors are encoded.
SAMPLE = 8_000
#: Candidates of each part of the index that are scored exactly first for a query.
RERANK = 400
PART_ROWS, PART_BYTES = (8_192, 262_144), 128 << 20
#: Lookup scores are sums of 32-bit numbers: their rounding error, relative to the norms of both vectors.
ROUNDING = 1e-5
#: What 32-bit numbers near zero may lack, for vectors of length one; scores that a task holds at a time.
TINY, SCORES = 1e-36, 1 << 22
#: Lengths of vectors that one table may hold: each has an index of its own.
MAX_LENGTHS = 64


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    c = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = (x @ c.T * -2 + (c * c).sum(1)).argmin(1)
        n = np.bincount(near, minlength=k)
        s = np.zeros_like(c)
        np.add.at(s, near, x)
        c = np.where(n[:, None] > 0, s / np.maximum(n, 1)[:, None], x[rng.integers(0, len(x), k)])
    return c


def encode(x: np.ndarray, books: np.ndarray, beam: int = BEAM) -> np.ndarray:
    """Codes (rows x books) by beam search: after each book the `beam` least errors go on."""
    m, k, d = books.shape
    out = np.zeros((len(x), m), np.uint8)
    for i in range(0, len(x), 1024):
        part = x[i : i + 1024]
        n = len(part)
        rest, codes = part[:, None, :], np.zeros((n, 1, 0), np.uint8)
        for b in range(m):
            err = (rest * rest).sum(2)[:, :, None] - 2 * (rest.reshape(-1, d) @ books[b].T).reshape(n, -1, k) + (books[b] ** 2).sum(1)
            flat = err.reshape(n, -1)
            take = min(beam, flat.shape[1])
            best = np.argpartition(flat, take - 1, 1)[:, :take]
            best = np.take_along_axis(best, np.take_along_axis(flat, best, 1).argsort(1, kind="stable"), 1)
            path, word = best // k, best % k
            rows = np.arange(n)[:, None]
            rest = rest[rows, path] - books[b][word]
            codes = np.concatenate([codes[rows, path], word[..., None].astype(np.uint8)], 2)
        out[i : i + n] = codes[:, 0]
    return out


def decode(codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    return sum(books[b][codes[:, b]] for b in range(len(books)))


def fit_books(x: np.ndarray, books: int = BOOKS, words: int = WORDS, seed: int = 7) -> np.ndarray:
    """Codebooks (books x words x dimensions): residual k-means, then least squares on the codes."""
    rng = np.random.default_rng(seed)
    k = min(words, len(x))
    rest, out = x.copy(), []
    for _ in range(books):
        c = _kmeans(rest, k, rng)
        out.append(c)
        rest = rest - c[(rest @ c.T * -2 + (c * c).sum(1)).argmin(1)]
    found = np.stack(out)
    codes = encode(x, found).astype(int)
    for _ in range(3):  # joint least squares by block coordinate descent: a codeword is the mean of what the other books leave
        left = x - decode(codes, found)
        for b in range(books):
            left += found[b][codes[:, b]]
            n = np.bincount(codes[:, b], minlength=k)
            s = np.zeros_like(found[b])
            np.add.at(s, codes[:, b], left)
            found[b] = np.where(n[:, None] > 0, s / np.maximum(n, 1)[:, None], found[b])
            left -= found[b][codes[:, b]]
    return found


def valid_vectors(rows: DataFrame) -> DataFrame:
    """vec_id, v (array<double>), row (a number of its own): what takes part."""
    v = F.col("embedding").cast("array<double>")
    rows = rows.select(F.col("vec_id").cast("long"), v.alias("v")).where("vec_id is not null and v is not null and size(v) > 0")
    rows = rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
    return rows.withColumn("row", F.monotonically_increasing_id())


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)


def search(rows: DataFrame, every: int = 20, k: int = 20, rerank: int = RERANK, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score: for rows whose id divides by `every`, the k nearest other rows by inner product."""
    base = materialise(valid_vectors(rows))
    lengths = sorted(r["d"] for r in base.select(F.size("v").alias("d")).distinct().limit(MAX_LENGTHS + 1).collect())
    if len(lengths) > MAX_LENGTHS:
        raise ValueError(f"vectors of more than {MAX_LENGTHS} lengths")
    out = rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for d in lengths:
        own = base if len(lengths) == 1 else materialise(base.where(F.size("v") == d))
        out = out.unionByName(_search(own, d, every, k, rerank, sample))
    return out


def _search(base: DataFrame, length: int, every: int, k: int, rerank: int, sample: int) -> DataFrame:
    """base: vec_id, v, all of one length; a table."""
    spark, total = base.sparkSession, base.count()
    pick = base if total <= sample else base.where(F.pmod(F.xxhash64("vec_id"), F.lit(1_000_000)) < int(sample / total * 1_000_000))
    found = pick.limit(4 * sample).toArrow()  # a bounded sample; the limit only guards it
    train = _matrix(found.column("v").combine_chunks(), len(found)) if len(found) else np.asarray(base.limit(1).toPandas().v.tolist())
    books = spark.sparkContext.broadcast(fit_books(train.astype(np.float64)).astype(np.float32))  # BOOKS x WORDS x dimensions
    part_rows = min(max(total // 24, PART_ROWS[0]), PART_ROWS[1], max(1024, PART_BYTES // (8 * length)))
    parts = -(-total // part_rows)

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 4096):
                p = b.slice(i, 4096)
                c = encode(_matrix(p.column(1), p.num_rows).astype(np.float32), books.value)
                approx = decode(c, books.value)
                norm, left = (np.sqrt((z.astype(np.float64) ** 2).sum(1)) for z in (approx, _matrix(p.column(1), p.num_rows) - approx))
                yield pa.record_batch([p.column(0), p.column(1), p.column(2), pa.array([x.tobytes() for x in c], pa.binary()), pa.array(norm), pa.array(left)], ["vec_id", "v", "row", "codes", "norm", "left"])

    index = materialise(base.select("vec_id", "v", "row").mapInArrow(codes, "vec_id long, v array<double>, row long, codes binary, norm double, left double"))
    part = F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int")
    stored = index.select(part.alias("part"), F.lit(0).alias("kind"), "vec_id", "v", "row", "codes", (F.col("left") + ROUNDING * (F.col("norm") + F.col("left"))).alias("slack"))
    queries = base.where(F.col("vec_id") % every == 0).select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(1).alias("kind"), "vec_id", "v", "row", F.lit(None).cast("binary").alias("codes"), F.lit(None).cast("double").alias("slack"))
    both = stored.unionByName(queries).repartition(min(parts, 4_096), "part").sortWithinPartitions("part", "kind", "vec_id")
    near = both.mapInArrow(_scan(books, k, rerank), "query long, query_id long, row long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "row"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


class Part:
    """A part of the index, sorted by first codeword, then id and row."""

    def __init__(self, books: np.ndarray, ids: np.ndarray, rows: np.ndarray, slack: np.ndarray, vecs: np.ndarray, codes: np.ndarray):
        order = np.lexsort((rows, ids, codes[:, 0]))
        self.ids, self.rows, self.slack, self.vecs = ids[order], rows[order], slack[order], vecs[order]
        self.codes = codes[order].T.astype(np.intp)
        self.cells, begin = np.unique(self.codes[0], return_index=True)
        self.begin, self.end = begin, np.append(begin[1:], len(ids))
        self.books, self.centres = books, books[0][self.cells].astype(np.float64)
        off = np.sqrt(((self.vecs - self.centres[np.repeat(np.arange(len(begin)), self.end - begin)]) ** 2).sum(1))
        self.reach = np.maximum.reduceat(off, begin) if len(begin) else off  # the largest distance of a member of each cell
        size = np.sqrt((self.vecs**2).sum(1))
        self.scale = float(size.max(initial=0.0)) or 1.0  # 32-bit copies are of length one at most
        self.approx = (decode(codes[order], books) / self.scale).astype(np.float32)
        self.vecs32 = (self.vecs / self.scale).astype(np.float32)
        self.slack32, self.reach32 = ((z / self.scale).astype(np.float32) for z in (self.slack, ROUNDING * size))

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """What no member of a cell can exceed: queries x cells."""
        norm = np.sqrt((q * q).sum(1))[:, None]
        size = np.sqrt((self.centres**2).sum(1)) + self.reach
        return q @ self.centres.T + norm * (self.reach + 1e-12 * size)  # with what rounding may add

    def members(self, cells: np.ndarray) -> np.ndarray:
        return np.concatenate([np.arange(self.begin[c], self.end[c]) for c in cells]) if len(cells) else np.zeros(0, np.intp)

    def looked_up(self, table: np.ndarray, at: np.ndarray) -> np.ndarray:
        score = np.zeros(len(at), np.float32)
        for t, c in zip(table, self.codes, strict=True):
            score += t[c[at]]
        return score

    def nearest(self, q: np.ndarray, table: np.ndarray, bound: np.ndarray, own: int, k: int, rerank: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Places and exact scores of the k nearest rows but the query's own, and how many rows were looked up."""
        return self.nearest_all(q[None], table[None], bound[None], np.array([own]), k, rerank)[0]

    def nearest_all(self, qs: np.ndarray, tables: np.ndarray, bounds: np.ndarray, owns: np.ndarray, k: int, rerank: int) -> list[tuple[np.ndarray, np.ndarray, int]]:
        """What `nearest` gives for each of some queries: the codes of all of them are scored in one matrix product, and so is the exact check of what the codes leave, in 32 bits with a bound for their rounding."""
        norms = np.sqrt((qs * qs).sum(1))
        exact = lambda n, at: (self.vecs[at] * qs[n]).sum(1)
        kth = np.full(len(qs), -np.inf)

        def raise_kth(n: int, scores: np.ndarray) -> None:
            if len(scores) >= k:
                kth[n] = max(kth[n], float(np.partition(scores, len(scores) - k)[len(scores) - k]))

        for n, bound in enumerate(bounds):  # the cells with the highest bounds give a first k-th score
            order = np.argsort(-bound, kind="stable")
            enough = int(np.searchsorted(np.cumsum(self.end[order] - self.begin[order]), rerank + 1)) + 1
            at = self.members(order[:enough])
            at = at[self.rows[at] != owns[n]]
            if len(at) > rerank:
                at = at[np.argpartition(-self.looked_up(tables[n], at), rerank - 1)[:rerank]]
            raise_kth(n, exact(n, at))
        cells = np.flatnonzero((bounds >= kth[:, None]).any(0))  # the others are skipped whole
        at = self.members(cells)
        pick = (lambda z: z) if len(at) == len(self.ids) else (lambda z: z[at])
        unit = (qs / norms[:, None]).astype(np.float32)
        score = unit @ pick(self.approx).T
        score[self.rows[at][None, :] == owns[:, None]] = -np.inf
        slack, reach = pick(self.slack32), pick(self.reach32)
        if len(at) > rerank:
            cuts = np.arange(0, len(at), -(-len(at) // rerank))
            ends = np.append(cuts[1:], len(at))
            best = np.stack([score[:, i:j].argmax(1) + i for i, j in zip(cuts, ends, strict=True)], 1)  # the best code of each stretch raises the k-th score further
            for n in range(len(qs)):
                own = at[best[n]]
                raise_kth(n, exact(n, own[self.rows[own] != owns[n]]))
        floor = np.where(np.isfinite(kth), kth / norms / self.scale - TINY, -np.inf).astype(np.float32)[:, None]
        left = score + slack >= floor
        left &= score > -np.inf
        left &= unit @ pick(self.vecs32).T + reach >= floor
        out = []
        for n in range(len(qs)):
            found = at[np.flatnonzero(left[n])]
            scores = exact(n, found)
            order = np.lexsort((self.rows[found], self.ids[found], -scores))[:k]
            out.append((found[order], scores[order], len(at)))
        return out


def _scan(books, k: int, rerank: int):
    """Over rows sorted by part and kind: holds a part of the index, then answers its queries as they come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, part = None, [], None
        for b in batches:
            key, kind = b.column("part").to_numpy(), b.column("kind").to_numpy()
            cuts = [0, *(np.flatnonzero((np.diff(key) != 0) | (np.diff(kind) != 0)) + 1), b.num_rows]
            for i, j in zip(cuts, cuts[1:], strict=False):
                if i == j:
                    continue
                p = b.slice(i, j - i)
                if key[i] != now:
                    now, held, part = key[i], [], None
                ids, rows, vecs = p.column("vec_id").to_numpy(), p.column("row").to_numpy(), _matrix(p.column("v"), j - i)
                if kind[i] == 0:
                    held.append((ids, rows, p.column("slack").to_numpy(), vecs, np.frombuffer(b"".join(p.column("codes").to_pylist()), np.uint8).reshape(j - i, -1)))
                    continue
                if part is None:
                    if not held:
                        continue
                    part, held = Part(books.value, *(np.concatenate(x) for x in zip(*held, strict=True))), []
                tables = np.einsum("qd,bkd->qbk", vecs.astype(np.float32), books.value)
                out, bounds, step = [], part.bounds(vecs), max(1, SCORES // len(part.ids))
                for m in range(0, len(ids), step):
                    own = slice(m, m + step)
                    for n, (at, scores, _) in enumerate(part.nearest_all(vecs[own], tables[own], bounds[own], rows[own], k, rerank), m):
                        out.append((np.full(len(at), rows[n]), np.full(len(at), ids[n]), part.rows[at], part.ids[at], scores))
                yield pa.record_batch([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["query", "query_id", "row", "vec_id", "score"])

    return run
