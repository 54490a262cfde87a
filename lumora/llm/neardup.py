"""N-gram Jaccard join: count vectors in R-trees bound overlaps, surviving pairs are verified.

A document's set is that of its distinct five-word shingles (64-bit hashes). Texts of the same set are
one class, named by a hash of the set; only classes are compared. A class meets the others that share
one of its first shingles in a global order, of which any linked pair shares one: the last fifth of a
set can't hold all of an overlap of four fifths. Frequent shingles come last in that order, so that
passages that many documents share bring few of them together. In each such meeting an R-tree indexes
the classes' count vectors (shingles hashed into GROUPS groups); for a query, the sum over the groups of
the smaller count bounds the overlap with a point, and with the upper corner of a node all points
below it. What survives is verified on the whole shingle sets.

A meeting of up to SMALL classes is a tree of one leaf. Larger meetings, and those that a task holds in
part, yield at first only pairs of neighbours in the tree's order. When these are verified and joined into components, the
tree is searched again for pairs across components: links inside a component can't change the
result, so a group of g near copies costs about g pairs a meeting, and no link between components is lost.

Rows are dealt by ranges of (shingle, size, class), so a meeting of any size is spread over tasks. The
second search takes it in cells of bounded size, points against queries, where the rows of the
meeting's largest component are points only. Class names are 64-bit hashes; a second hash tells whether two
sets share one, and then all is done again with other hashes.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumora.llm.common import as_bytes, drop_stored, fresh, stored, table, tokens
from lumora.llm.components import components

SHINGLE, GROUPS, FANOUT = 5, 16, 16
#: Groups of the finer vectors that candidates are held against before their texts are fetched.
FINE = 256
#: Meetings of up to so many classes are searched at once.
SMALL = 16
#: Up to so many large meetings (three numbers each) are broadcast; beyond, they are joined by shuffle.
BROADCAST_ROWS = 500_000
#: A shingle in at least so many documents is frequent; at most so many frequent ones are broadcast (8 bytes each).
#: Both only order the shingles: they change the work, never the result.
FREQUENT, FREQUENT_ROWS = 40, 200_000
#: Points and queries that a cell of a large meeting holds, on average.
SPLIT = 8192
#: Bits of the filter that keeps texts without candidates at home; false positives cost work only.
FILTER_BITS = 1 << 25
WORDS_KNOWN = 400_000
#: Stands for a null id.
LOWEST = -(2**63)

_P = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)
_SHORT = np.array([0, 0x2545F4914F6CDD1D, 0x9FB21C651E98DF25, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sorted distinct shingle hashes of texts; the hashes of words are remembered, within bounds."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def _word(self, w: bytes) -> int:
        if len(self.known) >= WORDS_KNOWN:
            self.known.clear()
        h = self.known[w] = xxhash.xxh3_64_intdigest(w)
        return h

    def __call__(self, text: bytes) -> np.ndarray:
        words = text.lower().split()
        get, miss, n = self.known.get, self._word, len(words)
        h = np.fromiter((get(w) or miss(w) for w in words), np.uint64, n)
        if n < SHINGLE:
            if not n:
                return h
            return _mix((h * _P[:n]).sum(keepdims=True) + _SHORT[n : n + 1])
        m = n - SHINGLE + 1
        s = h[:m] * _P[0]
        for k in range(1, SHINGLE):
            s += h[k : m + k] * _P[k]
        return np.unique(_mix(s))


def shingle_sets(texts: pa.Array, rows: int = 2000) -> Iterator[np.ndarray]:
    """What Shingler gives for each text, for `rows` texts at once: words are hashed once a portion."""
    for at in range(0, len(texts), rows):
        words, n = tokens(texts.slice(at, rows))
        words = words.dictionary_encode()
        each = np.fromiter(map(xxhash.xxh3_64_intdigest, words.dictionary.cast(pa.large_binary()).to_pylist()), np.uint64, len(words.dictionary))
        h = each[np.asarray(words.indices)]
        m = max(0, len(h) - SHINGLE + 1)
        s = h[:m] * _P[0]
        for k in range(1, SHINGLE):
            s += h[k : m + k] * _P[k]
        s = _mix(s)
        for a, k in zip((np.cumsum(n) - n).tolist(), n.tolist(), strict=True):
            if k >= SHINGLE:
                own = np.sort(s[a : a + k - SHINGLE + 1])
                yield own[np.concatenate([[True], own[1:] != own[:-1]])]
            elif k:
                yield _mix((h[a : a + k] * _P[:k]).sum(keepdims=True) + _SHORT[k : k + 1])
            else:
                yield h[:0]


def class_of(s: np.ndarray, seed: int = 0) -> int:
    """A 64-bit name of a set of shingles; another seed gives another one."""
    return int((_mix(s ^ (np.uint64(0x5851F42D4C957F2D) + np.uint64(seed))).sum(dtype=np.uint64) + np.uint64(len(s))).astype(np.int64))


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether 100 * intersection >= 80 * union, for sorted distinct arrays; never for an empty one."""
    if not len(a) or not len(b) or 5 * min(len(a), len(b)) < 4 * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 9 * both >= 4 * (len(a) + len(b))


def count_vector(s: np.ndarray, groups: int = GROUPS) -> bytes:
    """Counts of shingles by group, rounded up to multiples of a step so that each fits in a byte; the step goes first."""
    c = np.bincount((s >> np.uint64(20)).astype(np.int64) % groups, minlength=groups)
    step = max(1, -(-int(c.max()) // 255))
    return np.uint32(step).tobytes() + (-(-c // step)).astype(np.uint8).tobytes()


def counts_of(raw: list[bytes], groups: int = GROUPS) -> np.ndarray:
    flat = np.frombuffer(b"".join(raw), np.uint8).reshape(len(raw), 4 + groups)
    step = flat[:, :4].copy().view("<u4").astype(np.int64)
    return flat[:, 4:] * step


class CountTree:
    """An R-tree over count vectors, packed level by level in the order of set size; nodes keep their upper corners."""

    def __init__(self, sizes: np.ndarray, counts: np.ndarray, room: np.ndarray | None = None):
        """All sorted by size. room: the largest overlap that a point's place in the global order leaves."""
        self.levels = [(sizes, sizes, counts, sizes if room is None else room)]
        while len(self.levels[-1][0]) > FANOUT:
            low, high, corner, room = self.levels[-1]
            at = np.arange(0, len(low), FANOUT)
            self.levels.append((np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(corner, at, axis=0), np.maximum.reduceat(room, at)))

    def search(self, sizes: np.ndarray, counts: np.ndarray, room: np.ndarray | None = None, chunk: int = 1024) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, point) indexes of all pairs whose bounded overlap may reach the threshold, in portions."""
        for a in range(0, len(sizes), chunk):
            n, c = sizes[a : a + chunk], counts[a : a + chunk]
            left = n if room is None else room[a : a + chunk]
            top = len(self.levels[-1][0])
            q, p = np.repeat(np.arange(len(n)), top), np.tile(np.arange(top), len(n))
            for depth in range(len(self.levels) - 1, -1, -1):
                low, high, corner, space = self.levels[depth]
                least = np.maximum(low[p], -(-4 * n[q] // 5))
                near = (5 * high[p] >= 4 * n[q]) & (4 * low[p] <= 5 * n[q]) & (9 * np.minimum(space[p], left[q]) >= 4 * (n[q] + least))
                q, p = q[near], p[near]
                bound = np.concatenate([np.minimum(c[q[i : i + 65536]], corner[p[i : i + 65536]]).sum(axis=1) for i in range(0, len(q), 65536)] or [np.empty(0, np.int64)])
                least = np.maximum(low[p], -(-4 * n[q] // 5))
                may = 9 * np.minimum(bound, n[q]) >= 4 * (n[q] + least)
                q, p = q[may], p[may]
                if depth:
                    below = len(self.levels[depth - 1][0])
                    q = np.repeat(q, FANOUT)
                    p = (p[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                    q, p = q[p < below], p[p < below]
            yield q + a, p


def _rows(names: list[str], *arrays) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(arrays), names=names)


def sets_of(docs: DataFrame, seed: int) -> DataFrame:
    """Stored rows of two kinds: kind 0, a document (id, row, class, second name, n, fine); kind 1, a shingle (class) that n documents of a batch share.

    The counts of shingles are lossy: what occurs once in a batch isn't counted.
    """
    names = ["kind", "id", "row", "class", "second", "n", "fine"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = list(shingle_sets(b.column("text")))
            n = np.array([len(s) for s in sets], np.int64)
            yield _rows(names, pa.array([0] * len(sets), pa.int8()), b.column("id"), b.column("row"), pa.array([class_of(s, seed) for s in sets], pa.int64()), pa.array([class_of(s, seed + 1) for s in sets], pa.int64()), pa.array(n), pa.array([count_vector(s, FINE) if len(s) else None for s in sets], pa.binary()))
            # a copy in the batch counts once
            seen: dict[bytes, np.ndarray] = {s.tobytes(): s for s in sets}
            every = np.concatenate(list(seen.values())) if seen else np.empty(0, np.uint64)
            every.sort()
            starts = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]])) if len(every) else np.empty(0, np.int64)
            k = np.diff(np.concatenate([starts, [len(every)]]))
            often = k >= 2
            s = every[starts[often]].view(np.int64)
            yield _rows(names, pa.array(np.ones(len(s), np.int8)), pa.nulls(len(s), pa.int64()), pa.nulls(len(s), pa.int64()), pa.array(s), pa.nulls(len(s), pa.int64()), pa.array(k[often].astype(np.int64)), pa.nulls(len(s), pa.binary()))

    return stored(docs.mapInArrow(run, "kind tinyint, id long, row long, class long, second long, n long, fine binary"))


def prefixes(docs: DataFrame, frequent: np.ndarray, seed: int) -> DataFrame:
    """key, class, n, at, counts, stored: the first n/5 or so shingles of each class, rare ones first. A task tells a class once."""
    shared = docs.sparkSession.sparkContext.broadcast(np.sort(frequent.view(np.uint64)))
    names = ["key", "class", "n", "at", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, told = shared.value, set()
        for big in batches:
            for a in range(0, big.num_rows, 2000):
                keys, classes, sizes, ats, vectors = [], [], [], [], []
                for s in shingle_sets(big.column("text").slice(a, 2000)):
                    if not len(s) or (c := class_of(s, seed)) in told:
                        continue
                    told.add(c)
                    n = len(s)
                    k = n - (4 * n + 4) // 5 + 1
                    if len(hot):
                        i = np.searchsorted(hot, s)
                        often = hot[np.minimum(i, len(hot) - 1)] == s
                        first = s[~often][:k]
                        if len(first) < k:
                            first = np.concatenate([first, s[often][: k - len(first)]])
                    else:
                        first = s[:k]
                    keys.append(first)
                    classes.append(c)
                    sizes.append(n)
                    ats.append(k)
                    vectors.append(count_vector(s))
                if keys:
                    k = np.array(ats)
                    yield _rows(
                        names,
                        pa.array(np.concatenate(keys).view(np.int64)),
                        pa.array(np.repeat(np.array(classes, np.int64), k)),
                        pa.array(np.repeat(np.array(sizes, np.int32), k)),
                        pa.array(np.concatenate([np.arange(x, dtype=np.int32) for x in ats])),
                        pa.array([v for v, x in zip(vectors, ats, strict=True) for _ in range(x)], pa.binary()),
                    )

    return stored(docs.select("text").mapInArrow(run, "key long, class long, n int, at int, counts binary"))


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables that hold whole groups of rows; the rows come sorted by keys."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        change = np.zeros(b.num_rows, bool)
        for k in keys:
            x = b.column(k).to_numpy()
            change[1:] |= x[1:] != x[:-1]
        ends = np.flatnonzero(change)
        first_differs = bool(held) and any(held[-1].column(k)[held[-1].num_rows - 1] != b.column(k)[0] for k in keys)
        if first_differs:
            yield pa.Table.from_batches(held)
            held = []
        if len(ends):
            yield pa.Table.from_batches([*held, b.slice(0, int(ends[-1]))])
            held = [b.slice(int(ends[-1]))]
        else:
            held.append(b)
    if held:
        yield pa.Table.from_batches(held)


def _bounds(change: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.flatnonzero(np.concatenate([[True], change]))
    return starts, np.diff(np.concatenate([starts, [len(change) + 1]]))


def _distinct(a: list[np.ndarray], b: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    x = np.concatenate(a) if a else np.empty(0, np.int64)
    y = np.concatenate(b) if b else np.empty(0, np.int64)
    low, high = np.minimum(x, y), np.maximum(x, y)
    pair = np.unique(np.stack([low[low != high], high[low != high]], axis=1), axis=0)
    return pair[:, 0], pair[:, 1]


def meetings(rows: DataFrame) -> DataFrame:
    """Stored rows of two kinds: kind 0, a candidate pair (a, b); kind 1, a row of a large or cut meeting (key, a, n, room, counts).

    A task's first and last meeting may go on in other tasks.
    """
    names = ["kind", "key", "a", "b", "n", "room", "counts"]

    def found(t: pa.Table, first: bool, last: bool) -> Iterator[pa.RecordBatch]:
        key, cls, n, at = (t.column(c).to_numpy() for c in ("key", "class", "n", "at"))
        n, at = n.astype(np.int64), at.astype(np.int64)
        # rows come sorted by key, n and class: the same class from two tasks stands side by side
        keep = np.concatenate([[True], (key[1:] != key[:-1]) | (cls[1:] != cls[:-1])])
        rows_at = np.flatnonzero(keep)
        starts, size = _bounds(key[rows_at][1:] != key[rows_at][:-1])
        whole = np.ones(len(starts), bool)
        whole[[0] * first + [-1] * last] = False
        a_out, b_out = [], []
        two = starts[(size == 2) & whole]
        i, j = rows_at[two], rows_at[two + 1]
        a_out, b_out = [i], [j]
        leaf = (size > 2) & (size <= SMALL) & whole
        for s, g in zip(starts[leaf], size[leaf], strict=True):
            x, y = np.triu_indices(int(g), 1)
            a_out.append(rows_at[s + x])
            b_out.append(rows_at[s + y])
        i, j = np.concatenate(a_out), np.concatenate(b_out)
        if len(i):
            raw = t.column("counts")
            used, back = np.unique(np.concatenate([i, j]), return_inverse=True)
            c = counts_of(raw.take(pa.array(used)).to_pylist())
            ci, cj = back[: len(i)], back[len(i) :]
            ok = 5 * np.minimum(n[i], n[j]) >= 4 * np.maximum(n[i], n[j])
            ok &= 9 * np.minimum(n[i] - at[i], n[j] - at[j]) >= 4 * (n[i] + n[j])
            i, j, ci, cj = i[ok], j[ok], ci[ok], cj[ok]
            ok = 9 * np.minimum(c[ci], c[cj]).sum(axis=1) >= 4 * (n[i] + n[j])
            i, j = i[ok], j[ok]
        firsts, seconds = [cls[i]], [cls[j]]
        large = [(s, g) for s, g in zip(starts[(size > SMALL) | ~whole], size[(size > SMALL) | ~whole], strict=True)]
        for s, g in large:
            own = rows_at[s : s + g]
            # neighbours in the tree's order, and all with the one that the meeting's shingle comes first in
            hub = own[np.argmin(at[own] / n[own])]
            for x, y in ((own[:-1], own[1:]), (np.full(g, hub), own)):
                near = (9 * np.minimum(n[x] - at[x], n[y] - at[y]) >= 4 * (n[x] + n[y])) & (5 * np.minimum(n[x], n[y]) >= 4 * np.maximum(n[x], n[y]))
                firsts.append(cls[x][near])
                seconds.append(cls[y][near])
        a, b = _distinct(firsts, seconds)
        if len(a):
            yield _rows(names, pa.array(np.zeros(len(a), np.int8)), pa.nulls(len(a), pa.int64()), pa.array(a), pa.array(b), pa.nulls(len(a), pa.int32()), pa.nulls(len(a), pa.int32()), pa.nulls(len(a), pa.binary()))
        if large:
            own = np.concatenate([rows_at[s : s + g] for s, g in large])
            for k in range(0, len(own), 50_000):
                o = own[k : k + 50_000]
                yield _rows(names, pa.array(np.ones(len(o), np.int8)), pa.array(key[o]), pa.array(cls[o]), pa.nulls(len(o), pa.int64()), pa.array(n[o].astype(np.int32)), pa.array((n[o] - at[o]).astype(np.int32)), t.column("counts").take(pa.array(o)).combine_chunks().cast(pa.binary()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, first = None, True
        for t in _groups(batches, ["key"]):
            if held is not None:
                yield from found(held, first, False)
                first = False
            held = t
        if held is not None:
            yield from found(held, first, True)

    dealt = rows.repartitionByRange("key", "n", "class").sortWithinPartitions("key", "n", "class")
    return stored(dealt.mapInArrow(run, "kind tinyint, key long, a long, b long, n int, room int, counts binary"))


def across(large: DataFrame, parts: DataFrame) -> DataFrame:
    """a, b: pairs of large meetings whose classes lie in different components and whose bound may suffice.

    A cell holds a part of a meeting's rows as points and a part of those outside of its largest component as queries.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, ["key", "cell"]):
            key, cell, cls, comp, n, room = (t.column(c).to_numpy().astype(np.int64) for c in ("key", "cell", "a", "component", "n", "room"))
            asks = t.column("asks").to_numpy().astype(bool)
            counts = counts_of(t.column("counts").to_pylist())
            starts, size = _bounds((key[1:] != key[:-1]) | (cell[1:] != cell[:-1]))
            a, b = [], []
            for s, g in zip(starts, size, strict=True):
                own = np.arange(s, s + g)
                queries, points = own[asks[own]], own[~asks[own]]
                if not len(queries) or not len(points):
                    continue
                tree = CountTree(n[points], counts[points], room[points])
                for q, p in tree.search(n[queries], counts[queries], room[queries]):
                    q, p = queries[q], points[p]
                    other = comp[q] != comp[p]
                    a.append(cls[q[other]])
                    b.append(cls[p[other]])
            x, y = _distinct(a, b)
            if len(x):
                yield _rows(["a", "b"], pa.array(x), pa.array(y))

    rows = large.join(parts.select(F.col("node").alias("a"), "component"), "a", "left").withColumn("component", F.coalesce("component", "a"))
    each = rows.groupBy("key", "component").agg(F.count("*").alias("k"))
    open_ = each.groupBy("key").agg(F.sum("k").alias("g"), F.max(F.struct("k", "component")).alias("top"), F.count("*").alias("parts")).where("parts > 1")
    share = lambda n: F.ceil(n / SPLIT).cast("int")
    open_ = stored(open_.select("key", F.col("top.component").alias("largest"), share(F.col("g")).alias("ps"), share(F.col("g") - F.col("top.k")).alias("qs")))
    rows = rows.join(F.broadcast(open_) if open_.count() <= BROADCAST_ROWS else open_, "key")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    mine = lambda n: F.pmod(F.xxhash64("a"), n).cast("int")
    points = rows.withColumn("q", every(F.col("qs"))).withColumn("p", mine(F.col("ps"))).withColumn("asks", F.lit(False))
    queries = rows.where("component != largest").withColumn("p", every(F.col("ps"))).withColumn("q", mine(F.col("qs"))).withColumn("asks", F.lit(True))
    cells = points.unionByName(queries).withColumn("cell", F.col("p").cast("long") * F.col("qs") + F.col("q"))
    dealt = cells.select("key", "cell", "a", "component", "n", "room", "counts", "asks").repartition("key", "cell").sortWithinPartitions("key", "cell", "n", "a")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def _filter(rows: DataFrame, bit: Column) -> bytes:
    """A bit set of FILTER_BITS bits with each row's bit: at most one 8-byte word a 64 bits comes to the driver."""
    words = rows.select(bit.alias("x")).groupBy(F.floor(F.col("x") / 64).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(x % 64 as int))")).alias("v"))
    out = np.zeros(FILTER_BITS // 64, np.int64)
    for w, v in words.toLocalIterator():
        out[w] = v
    return out.tobytes()


def narrowed(pairs: DataFrame, names: DataFrame) -> DataFrame:
    """The pairs whose overlap the fine vectors don't rule out; stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, 2000):
                b = big.slice(at, 2000)
                na, nb = (b.column(c).to_numpy().astype(np.int64) for c in ("na", "nb"))
                bound = np.minimum(counts_of(b.column("fa").to_pylist(), FINE), counts_of(b.column("fb").to_pylist(), FINE)).sum(axis=1)
                keep = pa.array(9 * bound >= 4 * (na + nb))
                yield _rows(["a", "b"], b.column("a").filter(keep), b.column("b").filter(keep))

    side = lambda x: names.select(F.col("class").alias(x), F.col("n").alias(f"n{x}"), F.col("fine").alias(f"f{x}"))
    return stored(pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "fa", "fb").mapInArrow(run, "a long, b long"))


def verified(pairs: DataFrame, names: DataFrame, docs: DataFrame, seed: int) -> DataFrame:
    """a, b: the pairs of classes that are linked; stored. names: class, id of one of its documents, n, fine."""
    pairs = narrowed(pairs, names)
    needed = pairs.select(F.col("a").alias("class")).unionByName(pairs.select(F.col("b").alias("class"))).distinct().join(names, "class")
    needed = stored(needed.select("class", "id"))
    id_bit = F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS))
    bits = docs.sparkSession.sparkContext.broadcast((_filter(needed, id_bit), _filter(needed, F.pmod("class", F.lit(FILTER_BITS)))))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows of one id may have different texts: ids only save work, classes decide. A task tells a class once
        ids, classes = (np.frombuffer(x, np.uint8) for x in bits.value)
        told = set()
        for big in batches:
            x = big.column("bit").to_numpy()
            b = big.filter(pa.array((ids[x >> 3] >> (x & 7)) & 1 == 1))
            at, own = [], []
            for k, s in enumerate(shingle_sets(b.column("text"))):
                c = class_of(s, seed)
                x = c % FILTER_BITS
                if (classes[x >> 3] >> (x & 7)) & 1 and c not in told:
                    told.add(c)
                    at.append(k)
                    own.append(c)
            yield _rows(["class", "text"], pa.array(own, pa.int64()), b.column("text").take(pa.array(at, pa.int64())))

    some = docs.select("text", id_bit.alias("bit")).mapInArrow(pick, "class long, text string")
    texts = stored(needed.select("class").join(some, "class").groupBy("class").agg(F.min("text").alias("text")))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, last, x = Shingler(), None, None
        for big in batches:
            for start in range(0, big.num_rows, 200):  # long texts: few are copied at once
                b = big.slice(start, 200)
                a_ids, b_ids = b.column("a"), b.column("b")
                keep = []
                for k, (a, ta, tb) in enumerate(zip(a_ids.to_pylist(), as_bytes(b.column("ta")), as_bytes(b.column("tb")), strict=True)):
                    if a != last:
                        last, x = a, shingles(ta)
                    if linked(x, shingles(tb)):
                        keep.append(k)
                at = pa.array(keep, pa.int64())
                yield _rows(["a", "b"], a_ids.take(at), b_ids.take(at))

    joined = pairs.join(texts.select(F.col("class").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("class").alias("b"), F.col("text").alias("tb")), "b")
    out = stored(joined.select("a", "b", "ta", "tb").mapInArrow(check, "a long, b long"))
    drop_stored(needed, texts)
    return out


def _release(spark: SparkSession) -> None:
    """Lets Spark's cleaner delete shuffle files of frames that are gone."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _grouped(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows (id, row, class, n) of texts (id, row, text), and of each class with words its component (class, id, component)."""
    spark, seed = texts.sparkSession, 0
    while True:
        sets = sets_of(texts, seed)
        mine = sets.where("kind = 0 and n > 0")
        names = stored(mine.groupBy("class").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("fine").alias("fine"), F.min("second").alias("least"), F.max("second").alias("most")))
        if names.where("least != most").isEmpty():
            break
        drop_stored(sets, names)  # two sets share a name
        seed += 2
    names = names.drop("least", "most")
    often = sets.where("kind = 1").groupBy("class").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT).orderBy(F.desc("n"), "class").limit(FREQUENT_ROWS)
    frequent = np.array([r[0] for r in often.select("class").collect()], np.int64)
    rows = prefixes(texts, frequent, seed)
    met = meetings(rows)
    drop_stored(rows)
    _release(spark)
    pairs = stored(met.where("kind = 0").select("a", "b").distinct())
    links = verified(pairs, names, texts, seed)
    parts = components(links)
    large = met.where("kind = 1").select("key", "a", "n", "room", "counts")
    if not large.isEmpty():
        more = stored(across(large, parts).join(pairs, ["a", "b"], "left_anti"))
        if not more.isEmpty():
            parts = components(links.unionByName(verified(more, names, texts, seed)))
    _release(spark)
    grouped = names.join(parts.withColumnRenamed("node", "class"), "class", "left").select("class", "id", F.coalesce("component", "class").alias("component"))
    return sets.where("kind = 0"), grouped


def _texts(docs: DataFrame, row: Column) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST)).alias("id"), row.alias("row"), "text")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id: one row for each row of docs.

    docs: doc_id, text; other columns are ignored. component_id is the least doc_id that links reach;
    a document without words is linked with nothing, whatever other rows have its id. A null id counts as
    the least of all and is given as null. Repeated rows are in one class. No rows give no rows.
    """
    own, grouped = _grouped(_texts(docs, F.lit(0).cast("long")))
    least = grouped.groupBy("component").agg(F.min("id").alias("least"))
    told = grouped.join(least, "component").select("class", "least")
    out = own.where("n > 0").join(told, "class").select("id", "n", "least").unionByName(own.where("n = 0").select("id", "n", F.col("id").alias("least")))
    real = lambda c: F.when(F.col(c) != LOWEST, F.col(c))
    return out.select(real("id").alias("doc_id"), F.col("n").alias("n_shingles"), real("least").alias("component_id"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs with one row of each group: one of the least doc_id; rows without words all stay.

    A null doc_id is the least of all. Of repeated rows one stays. An empty table stays empty; columns of any name stay.
    """
    number = fresh(docs, "row")
    numbered = stored(docs.withColumn(number, F.monotonically_increasing_id()))
    own, grouped = _grouped(_texts(numbered, F.col(number)))
    # a row a class first: copies don't meet in one task
    first = own.where("n > 0").groupBy("class").agg(F.min(F.struct("id", "row")).alias("first"))
    best = first.join(grouped.select("class", "component"), "class").groupBy("component").agg(F.min("first").alias("best"))
    keep = best.select(F.col("best.row").alias(number)).unionByName(own.where("n = 0").select(F.col("row").alias(number)))
    return numbered.join(keep, number, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP2_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, chr(10))]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], chr(10)))) END AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS k FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM o WHERE 100 * k >= 80 * (na + nb - k)),
g AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS c FROM s UNION SELECT g.b, r.c FROM r JOIN g ON r.doc_id = g.a WHERE r.c < g.b)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, m.c AS component_id
FROM s JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id) m ON m.doc_id = s.doc_id
"""
