"""Exact n-gram Jaccard join by signature trees (operator 10).

Texts with equal shingle sets are one class. A class sends its number to the rarest of its shingles (longest first, then by
hash): as many as two sets of the needed similarity must share at least one of (prefix filter; no pair is lost). The
classes that meet at a shingle form a unit of bounded size; a unit that outgrows the bound is dealt out as blocks, and
pairs of blocks. Within a unit a signature tree is built: members sorted by size, nodes with OR-combined token
bitmaps and size ranges. Dual traversal drops pairs of nodes, then of members, whose largest possible overlap is
below what their sizes need. What is left is verified on the whole sets. Units of many members first send each member's likeliest
partner alone; once those links are merged, a second traversal sends the rest of the pairs that lie in different components.

Shingle codes keep 56 bits of hash (48 where pairs are verified): two different shingles of a pair are taken for the same with a
chance of about 1e-9 for texts of a thousand words. Classes are told apart by 64 bits of hash over all their shingles.
Defined results: null, empty and wordless texts have no shingles and link with nothing; texts shorter than a shingle
are one shingle; repeated rows and equal texts share a component; a null doc_id is never a component's number unless it is alone;
empty tables give empty results. Columns other than doc_id and text are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veldspar.llm.common import drop_tables, materialise, mix, recorded, shingles, sized, text_slices, word_hashes, word_spans
from veldspar.operators.components import components

#: Bits of a token bitmap: the power of two that holds a bit for each shingle, within these.
BITS = (2048, 1 << 17)
#: Members of a unit at most.
BLOCK = 1024
#: Units up to this size send all their candidates at once.
SMALL = 16
LEAF, FAN = 8, 8


def shingle_codes(data: np.ndarray, offsets: np.ndarray, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct codes) of each text with a word. Order of codes: longer shingles first, then by hash."""
    starts, ends, first = word_spans(data, offsets)
    hashes = word_hashes(data, starts, ends)
    long = shingles(hashes, width)
    size = np.concatenate([[0], np.cumsum(ends - starts)])
    length = np.minimum(size[width:] - size[:-width], 255).astype(np.uint64) if len(long) else np.zeros(0, np.uint64)
    codes = ((np.uint64(255) - length) << np.uint64(56)) | (long >> np.uint64(8))
    for row in range(len(offsets) - 1):
        i, j = int(first[row]), int(first[row + 1])
        if j - i >= width:
            yield row, np.unique(codes[i : j - width + 1])
        elif j > i:
            yield row, (shingles(hashes[i:j], j - i) >> np.uint64(8)) + np.uint64(j - i)


def class_id(codes: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        return int(mix(mix(codes, 5).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(codes)), 6).view(np.int64)[0])


def _bitmap(codes: np.ndarray) -> bytes:
    size = min(max(BITS[0], 1 << (len(codes) - 1).bit_length()), BITS[1])
    on = np.zeros(size, bool)
    on[(mix(codes, 9) & np.uint64(size - 1)).astype(np.int64)] = True
    return np.packbits(on).tobytes()


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def signatures(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """doc_id, th (hash of the text), cid (class), n, prefix, bits; cid is null without shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, n, data, offsets in text_slices(b.column(2)):
                cid, size, prefix, bits = [None] * n, [0] * n, [None] * n, [None] * n
                for row, codes in shingle_codes(data, offsets, width):
                    cid[row], size[row], bits[row] = class_id(codes), len(codes), _bitmap(codes)
                    prefix[row] = codes[: prefix_length(len(codes), percent)].view(np.int64)
                yield pa.record_batch([b.column(0).slice(i, n), b.column(1).slice(i, n), pa.array(cid, pa.int64()), pa.array(size, pa.int64()), pa.array(prefix, pa.list_(pa.int64())), pa.array(bits, pa.binary())], ["doc_id", "th", "cid", "n", "prefix", "bits"])

    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("th"), "text")
    return rows.mapInArrow(run, "doc_id long, th long, cid long, n long, prefix array<long>, bits binary")


def _blocks(percent: int):
    """Over rows sorted by code, n, cid: blocks of at most BLOCK members of a code whose sizes follow without a gap that no link spans.
    open: the run of members may go on in another block."""

    def out(code, opened, cids, ns, offsets):
        lists = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(x, pa.int64())) for x in (cids, ns)]
        return pa.record_batch([pa.array(code, pa.int64()), pa.array(opened, pa.bool_()), *lists], ["code", "open", "cids", "ns"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry: tuple[np.ndarray, ...] = (np.zeros(0, np.int64),) * 3
        begun = True  # the run at the front may have begun elsewhere: in another task, or in blocks that have left
        for b in batches:
            code, cid, n = cols = [np.concatenate([c, b.column(k).to_numpy()]) for c, k in zip(carry, ("code", "cid", "n"), strict=True)]
            if not len(code):
                continue
            begin = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (100 * n[:-1] < percent * n[1:])]))
            end = np.append(begin[1:], len(code))
            size = (end - begin)[:-1]
            keep = size > 1
            if begun and len(size):
                keep[0] = True
            at = np.flatnonzero(keep)
            spans = [(s, min(s + BLOCK, end[k]), k) for k in at for s in range(begin[k], end[k], BLOCK)]
            if spans:
                take = np.concatenate([np.arange(s, e) for s, e, _ in spans])
                opened = [bool(size[k] > BLOCK or (begun and k == 0)) for _, _, k in spans]
                yield out([code[s] for s, _, _ in spans], opened, cid[take], n[take], np.concatenate([[0], np.cumsum([e - s for s, e, _ in spans])]))
            s = begin[-1]
            begun = begun and not len(size)
            while len(code) - s >= 2 * BLOCK:  # a hot shingle: blocks leave as they fill
                begun = True
                yield out([code[s]], [True], cid[s : s + BLOCK], n[s : s + BLOCK], [0, BLOCK])
                s += BLOCK
            carry = tuple(x[s:] for x in cols)
        code, cid, n = carry
        for s in range(0, len(code), BLOCK):
            yield out([code[s]], [True], cid[s : s + BLOCK], n[s : s + BLOCK], [0, len(code[s : s + BLOCK])])

    return run


class _Tree:
    """Members sorted by size; level 0 holds leaves of LEAF members, each higher level FAN nodes of the one below."""

    def __init__(self, n: np.ndarray, bits: np.ndarray):
        self.n, self.bits = n, bits
        self.pop = np.bitwise_count(bits).sum(1).astype(np.int64)
        coll = n - self.pop
        self.levels = []
        low, high, over, union, step = n, n, coll, bits, LEAF
        while True:
            cut = np.arange(0, len(low), step)
            low, high = np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut)
            over, union = np.maximum.reduceat(over, cut), np.bitwise_or.reduceat(union, cut)
            self.levels.append((low, high, over, union))
            step = FAN
            if len(low) <= FAN:
                break


def _children(pairs: np.ndarray, fan: int, sizes: tuple[int, int], same: bool) -> np.ndarray:
    grid = np.stack(np.meshgrid(np.arange(fan), np.arange(fan), indexing="ij"), -1).reshape(1, -1, 2)
    out = (pairs[:, None, :] * fan + grid).reshape(-1, 2)
    out = out[(out[:, 0] < sizes[0]) & (out[:, 1] < sizes[1])]
    return out[out[:, 0] <= out[:, 1]] if same else out


def traverse(left: _Tree, right: _Tree, percent: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Candidate pairs of members (i < j if same) and the largest overlap that their bitmaps allow, as a share of what is needed."""
    depth = max(len(left.levels), len(right.levels))
    pick = lambda t, k: t.levels[min(k, len(t.levels) - 1)]
    if len(left.levels) != len(right.levels):  # the flatter tree waits at its root level: start both at the level they share
        depth = min(len(left.levels), len(right.levels))
    a, b = pick(left, depth - 1), pick(right, depth - 1)
    pairs = np.stack(np.meshgrid(np.arange(len(a[0])), np.arange(len(b[0])), indexing="ij"), -1).reshape(-1, 2)
    if same:
        pairs = pairs[pairs[:, 0] <= pairs[:, 1]]
    for level in range(depth - 1, -1, -1):
        (lo_a, hi_a, over_a, un_a), (lo_b, hi_b, over_b, un_b) = left.levels[level], right.levels[level]
        i, j = pairs.T
        ok = (100 * hi_a[i] >= percent * lo_b[j]) & (100 * hi_b[j] >= percent * lo_a[i])
        pairs, i, j = pairs[ok], i[ok], j[ok]
        shared = np.concatenate([np.bitwise_count(un_a[i[s : s + 4096]] & un_b[j[s : s + 4096]]).sum(1) for s in range(0, len(i), 4096)] or [np.zeros(0, np.int64)]).astype(np.int64)
        most = np.minimum(np.minimum(shared + over_a[i], shared + over_b[j]), np.minimum(hi_a[i], hi_b[j]))
        pairs = pairs[most * (100 + percent) >= percent * (lo_a[i] + lo_b[j])]
        fan = LEAF if level == 0 else FAN
        sizes = (len(left.n), len(right.n)) if level == 0 else (len(left.levels[level - 1][0]), len(right.levels[level - 1][0]))
        pairs = _children(pairs, fan, sizes, same)
    if same:
        pairs = pairs[pairs[:, 0] < pairs[:, 1]]
    i, j = pairs.T
    ok = (100 * left.n[i] >= percent * right.n[j]) & (100 * right.n[j] >= percent * left.n[i])
    pairs, i, j = pairs[ok], i[ok], j[ok]
    shared = np.concatenate([np.bitwise_count(left.bits[i[s : s + 4096]] & right.bits[j[s : s + 4096]]).sum(1) for s in range(0, len(i), 4096)] or [np.zeros(0, np.int64)]).astype(np.int64)
    most = np.minimum(left.n[i] - left.pop[i] + shared, right.n[j] - right.pop[j] + shared)
    need = percent * (left.n[i] + right.n[j])
    ok = most * (100 + percent) >= need
    return pairs[ok], (most[ok] * (100 + percent)) / need[ok]


def _folded(bits: list[bytes], width: int) -> np.ndarray:
    """Bitmaps as rows of words, folded to width bytes (bit numbers are hashes modulo a power of two)."""
    words = np.frombuffer(b"".join(bits), np.uint64).reshape(len(bits), -1, width // 8)
    return np.bitwise_or.reduce(words, axis=1)


def _candidates(percent: int, final: bool):
    """Over rows sorted by unit, side, n, cid: candidate pairs (a < b) of each unit."""

    def unit(side, cid, n, bits, root):
        cross = side.max() > 0
        width = np.fromiter(map(len, bits), np.int64, len(bits))
        left, right, most = [], [], []
        for w in np.unique(width):
            own = width == w
            for v in (w, 2 * w) if not cross else (w // 2, w, 2 * w):  # sizes of a pair differ too little for others
                a, b = np.flatnonzero(own & (side == 0)), np.flatnonzero((width == v) & (side == int(cross)))
                if len(a) == 0 or len(b) == 0:
                    continue
                same = not cross and v == w
                trees = [_Tree(n[p], _folded([bits[k] for k in p], int(min(v, w)))) for p in ((a,) if same else (a, b))]
                pairs, share = traverse(trees[0], trees[-1], percent, same)
                left.append(a[pairs[:, 0]])
                right.append(b[pairs[:, 1]])
                most.append(share)
        if not left:
            return None
        i, j, share = np.concatenate(left), np.concatenate(right), np.concatenate(most)
        ok = root[i] != root[j]
        i, j, share = i[ok], j[ok], share[ok]
        if not final and len(cid) > SMALL and len(i):  # each member's likeliest partner
            who, other, s = np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([share, share])
            order = np.lexsort((cid[other], -s, who))
            lead = order[np.concatenate([[True], who[order][1:] != who[order][:-1]])]
            i, j = who[lead], other[lead]
        return np.unique(np.stack([np.minimum(cid[i], cid[j]), np.maximum(cid[i], cid[j])]), axis=1) if len(i) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        now = None
        out: list[np.ndarray] = []

        def close():
            if held:
                side, cid, n, bits, root = (sum((h[k] for h in held), []) if k == 3 else np.concatenate([h[k] for h in held]) for k in range(5))
                if len(cid) > 1 and (found := unit(side, cid, n, bits, root)) is not None:
                    out.append(found)
            held.clear()

        for b in batches:
            key = b.column("unit").to_numpy()
            cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1), len(key)]
            cols = [b.column(k).to_numpy() for k in ("side", "cid", "n")]
            bits, root = b.column("bits").to_pylist(), b.column("root").to_numpy()
            for s, e in zip(cuts, cuts[1:], strict=False):
                if s == e:
                    continue
                if key[s] != now:
                    close()
                    now = key[s]
                held.append((cols[0][s:e], cols[1][s:e], cols[2][s:e], bits[s:e], root[s:e]))
            if sum(x.shape[1] for x in out) > 50_000:
                yield pa.record_batch([pa.array(x) for x in np.concatenate(out, 1)], ["a", "b"])
                out = []
        close()
        if out:
            yield pa.record_batch([pa.array(x) for x in np.concatenate(out, 1)], ["a", "b"])

    return run


def _units(sig: DataFrame, percent: int) -> DataFrame:
    """unit, side, cid, n, size: the members of every unit."""
    reps = sig.where("cid is not null").groupBy("cid").agg(F.first("n").alias("n"), F.first("prefix").alias("prefix"))
    posts = reps.select(F.explode("prefix").alias("code"), "cid", "n")
    spark = sig.sparkSession
    dealt = posts.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "code", "n", "cid").sortWithinPartitions("code", "n", "cid")
    blocks = materialise(dealt.mapInArrow(_blocks(percent), "code long, open boolean, cids array<long>, ns array<long>"))
    # blocks of codes that may go on elsewhere
    opened = blocks.where("open").withColumn("id", F.xxhash64("code", "cids"))
    lo, hi = F.array_min("ns"), F.array_max("ns")
    opened = materialise(opened.select("code", "id", "cids", "ns", lo.alias("lo"), hi.alias("hi")))
    other = opened.select("code", *[F.col(c).alias(f"r_{c}") for c in ("id", "cids", "ns", "lo", "hi")])
    cross = opened.join(other, "code").where(f"id < r_id and 100 * hi >= {percent} * r_lo and 100 * r_hi >= {percent} * lo")  # blocks, not members
    cross = cross.select(F.xxhash64("id", "r_id").alias("unit"), F.array(F.struct("cids", "ns"), F.struct(F.col("r_cids").alias("cids"), F.col("r_ns").alias("ns"))).alias("sides"))
    alone = blocks.where("not open").select("cids", "ns").union(opened.select("cids", "ns")).where(F.size("cids") > 1)
    alone = alone.withColumn("unit", F.xxhash64("cids")).dropDuplicates(["unit"])  # the same members meet at many shingles
    alone = alone.select("unit", F.array(F.struct("cids", "ns")).alias("sides"))
    units = alone.union(cross).dropDuplicates(["unit"])
    members = units.select("unit", F.aggregate("sides", F.lit(0), lambda a, s: a + F.size(s["cids"])).alias("size"), F.posexplode("sides").alias("side", "s"))
    return materialise(members.select("unit", "size", "side", F.explode(F.arrays_zip("s.cids", "s.ns")).alias("m")).select("unit", "size", "side", F.col("m.cids").alias("cid"), F.col("m.ns").alias("n")))


def _verified(docs: DataFrame, classes: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough."""
    need = pairs.select(F.col("a").alias("cid")).union(pairs.select("b")).distinct()
    texts = materialise(classes.join(sized(materialise(need)), "cid", "left_semi").select(F.col("th").alias("need")).distinct())

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, data, offsets in text_slices(b.column(0)):
                cid, sets = [], []
                for _, codes in shingle_codes(data, offsets, width):
                    cid.append(class_id(codes))
                    sets.append(np.sort(codes & np.uint64((1 << 48) - 1)).view(np.uint8).reshape(-1, 8)[:, :6].tobytes())
                yield pa.record_batch([pa.array(cid, pa.int64()), pa.array(sets, pa.binary())], ["cid", "codes"])

    rows = docs.select("text", F.xxhash64("text").alias("th")).join(sized(texts), F.col("th") == F.col("need"), "left_semi").select("text")
    sets = materialise(rows.mapInArrow(full, "cid long, codes binary").groupBy("cid").agg(F.first("codes").alias("codes")), "uncompressed")
    both = pairs.join(sets.select(F.col("cid").alias("a"), F.col("codes").alias("x")), "a").join(sets.select(F.col("cid").alias("b"), F.col("codes").alias("y")), "b")

    def numbers(raw: bytes) -> np.ndarray:
        out = np.zeros((len(raw) // 6, 8), np.uint8)
        out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
        return out.view(np.uint64).ravel()

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column("x"), b.column("y"), strict=True):
                x, y = numbers(x.as_py()), numbers(y.as_py())
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep.append((100 + percent) * shared >= percent * (len(x) + len(y)))
            mask = pa.array(keep, pa.bool_())
            yield pa.record_batch([b.column("a").filter(mask), b.column("b").filter(mask)], ["u", "v"])

    return materialise(both.mapInArrow(check, "u long, v long"))


def jaccard_components(docs: DataFrame, width: int = 4, percent: int = 85) -> DataFrame:
    """A row per document: doc_id, n_shingles, component_id, class_id (null without shingles)."""
    if not 50 <= percent <= 100:
        raise ValueError("bitmaps and blocks are laid out for similarities of 50 to 100 per cent")
    spark = docs.sparkSession
    sig = materialise(signatures(docs, width, percent))
    classes = materialise(sig.where("cid is not null").groupBy("cid").agg(F.min("doc_id").alias("rep"), F.min("th").alias("th")))
    with recorded() as spent:
        units = _units(sig, percent)
        spent.pop()  # the units' own table stays
    drop_tables(spark, spent)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def found(rows: DataFrame, final: bool) -> DataFrame:
        """rows: unit, side, cid, n, root."""
        active = materialise(rows.select("cid").distinct())
        bits = sig.select("cid", "bits").join(sized(active), "cid", "left_semi").groupBy("cid").agg(F.first("bits").alias("bits"))
        cols = rows.join(bits, "cid").select("unit", "side", "cid", "n", "bits", "root").repartition(parts, "unit").sortWithinPartitions("unit", "side", "n", "cid")
        return cols.mapInArrow(_candidates(percent, final), "a long, b long").distinct()

    with recorded() as spent:
        pairs = materialise(found(units.withColumn("root", F.col("cid")), False))
        with recorded() as used:
            links = _verified(docs, classes, pairs, width, percent)
            used.pop()
        drop_tables(spark, used)
        roots = components(links)
        # units whose members lie in one component already have nothing to add: they leave before bitmaps are joined
        large = units.where(F.col("size") > SMALL).join(roots.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
        unsettled = materialise(large.groupBy("unit").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi").select("unit"))
        rest = materialise(found(large.join(sized(unsettled), "unit", "left_semi"), True).join(pairs, ["a", "b"], "left_anti"))
        if not rest.isEmpty():
            roots = components(links.union(_verified(docs, classes, rest, width, percent)))
        named = classes.join(roots.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
        least = named.groupBy("root").agg(F.min("rep").alias("component_id"))
        named = materialise(named.join(least, "root").select("cid", "component_id"))
        spent.pop()
    drop_tables(spark, spent)
    rows = sig.select("doc_id", F.col("n").alias("n_shingles"), F.col("cid").alias("class_id")).join(named.withColumnRenamed("cid", "class_id"), "class_id", "left")
    return rows.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "class_id")


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The documents with one of each group: that with the smallest doc_id (a null one only if it is alone); texts without words all stay."""
    found = jaccard_components(docs, width, percent)
    gone = materialise(found.where("n_shingles > 0 and (doc_id != component_id or (doc_id is null and component_id is not null))").select(F.col("doc_id").alias("__id")).distinct())
    rows = docs.select(F.struct(*docs.columns).alias("__doc"), F.col("doc_id").cast("long").alias("__key"))
    kept = rows.join(sized(gone), F.col("__key").eqNullSafe(F.col("__id")), "left_anti").select("__doc.*")
    return kept
