"""Exact top-k search by inner product, with aggregation that never reads a score at random.

Every block of vectors keeps one list a dimension, sorted by that component. A query with a positive
weight reads the list from its top, one with a negative weight from its bottom. Reading starts
shallow and doubles its depth; after each round every vector of the block has a lower and an upper bound: what was
read of it, plus the worst or best value that the unread part of each list can still give. The k-th
largest lower bound, of this block or of earlier ones, is what a vector has to reach. When few can, the lists are read on
to where the last of these stands, which gives their scores; all others are never read whole.

Queries are dealt to passes of a bounded number of bytes, each of which is broadcast and meets the
vectors where they lie: vectors are moved once, whatever the number of queries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumora.llm.common import drop_stored, stored, table

#: Largest absolute value up to which sums of products stay exact in doubles.
EXACT = float(2**53)
#: Vectors a list holds, queries that read them at once, vectors a task, and bytes of queries a pass.
BLOCK, QUERIES, TASK, PASS_BYTES = 2048, 512, 8192, 32_000_000
#: Contenders for each of the k places up to which a query's final scores are read.
CONTENDERS = 4


class Lists:
    """The sorted lists of one block: x has a row a vector, a column a dimension."""

    def __init__(self, x: np.ndarray):
        self.x, self.sorted = x, np.sort(x, axis=0)
        order = np.argsort(x, axis=0, kind="stable")
        #: the place of each entry in its list, from the bottom
        self.place = np.empty(order.shape, np.int32)
        np.put_along_axis(self.place, order, np.arange(len(x), dtype=np.int32)[:, None], axis=0)

    def bounds(self, depth: int, up: np.ndarray, down: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds [query, vector] after `depth` sequential reads of each list end.

        up and down: the queries' positive and negative weights. An entry that equals the last one read counts as read.
        """
        x, s = self.x, self.sorted
        high, low = s[-depth], s[depth - 1]
        upper = up @ np.maximum(x, high).T + down @ np.minimum(x, low).T
        lower = up @ np.where(x >= high, x, s[0]).T + down @ np.where(x <= low, x, s[-1]).T
        return lower, upper

    def depths(self, q: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
        """How far each query (a row of q) reads each list until it has met all of its contenders, the pairs (rows, cols)."""
        n, out = len(self.x), np.zeros(q.shape, np.int64)
        place = self.place[cols]
        np.maximum.at(out, rows, np.where(q[rows] > 0, n - place, np.where(q[rows] < 0, place + 1, 0)))
        return out


class Search:
    """The k best of all blocks that were added, for each of some queries."""

    def __init__(self, keys: np.ndarray, q: np.ndarray, k: int):
        """keys: a number for each query's own row, which is no candidate for it."""
        self.keys, self.q, self.k = keys, q, k
        self.best: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty(0, q.dtype))] * len(q)
        #: list entries read, and entries of all lists
        self.read = self.all = 0

    def add(self, keys: np.ndarray, ids: np.ndarray, x: np.ndarray) -> None:
        d = max(self.q.shape[1], x.shape[1])
        self.q, x = np.pad(self.q, ((0, 0), (0, d - self.q.shape[1]))), np.pad(x, ((0, 0), (0, d - x.shape[1])))
        most = lambda a: max(1, abs(a.max(initial=0)), abs(a.min(initial=0)))
        if self.q.dtype != object and float(most(self.q)) * float(most(x)) * max(d, 1) >= EXACT:
            self.q = _whole(self.q)
            self.best = [(i, _whole(v)) for i, v in self.best]
        if self.q.dtype == object:
            x = _whole(x)
        for at in range(0, len(ids), BLOCK):
            lists = Lists(x[at : at + BLOCK])
            for a in range(0, len(self.q), QUERIES):
                self._block(lists, keys[at : at + BLOCK], ids[at : at + BLOCK], np.arange(a, min(a + QUERIES, len(self.q))))

    def _block(self, lists: Lists, keys: np.ndarray, ids: np.ndarray, live: np.ndarray) -> None:
        k, n, d = self.k, *lists.x.shape
        if not d:
            lists = Lists(np.zeros((n, 1), self.q.dtype))
        self.all += n * int((self.q[live] != 0).sum())
        depth = min(n, max(1, n // 64))
        floor = np.array([b[1][k - 1] if len(b[1]) >= k else -np.inf for b in self.best], self.q.dtype)
        while len(live):
            q = self.q[live] if d else np.zeros((len(live), 1), self.q.dtype)
            lower, upper = lists.bounds(depth, np.where(q > 0, q, 0), np.where(q < 0, q, 0))
            mine = keys[None, :] == self.keys[live, None]
            if mine.any():
                lower = np.where(mine, -np.inf, lower)
            need = floor[live]
            if n >= k:
                kth = np.sort(lower, axis=1)[:, n - k] if lower.dtype == object else np.partition(lower, n - k, axis=1)[:, n - k]
                need = np.maximum(need, kth)
            wanted = (upper >= need[:, None]) & ~mine  # an equal one may have the smaller id
            done = (wanted.sum(axis=1) <= CONTENDERS * k) | (depth >= n)
            rows, cols = np.nonzero(wanted & done[:, None])
            read = np.where(q[done] != 0, depth, 0)
            if depth < n and len(rows):
                read = np.maximum(read, lists.depths(q, rows, cols)[done])
            self.read += int(read.sum())
            scores = (q[rows] * lists.x[cols]).sum(axis=1) if d else np.zeros(len(rows), q.dtype)
            ends = np.searchsorted(rows, np.arange(len(live) + 1))
            for i in np.flatnonzero(ends[1:] > ends[:-1]):
                a, b = ends[i], ends[i + 1]
                old = self.best[live[i]]
                i_, s_ = np.concatenate([old[0], ids[cols[a:b]]]), np.concatenate([old[1], scores[a:b]])
                order = np.lexsort((i_, -s_))[:k]
                self.best[live[i]] = i_[order], s_[order]
            live, depth = live[~done], min(n, 2 * depth)


def _whole(x: np.ndarray) -> np.ndarray:
    """Whole numbers as Python's, which don't overflow."""
    return x if x.dtype == object else np.array([int(v) for v in x.ravel()], dtype=object).reshape(x.shape)


def _matrix(v: pa.Array) -> np.ndarray:
    """A matrix of lists, padded with zeros to the longest."""
    flat, ends = np.asarray(v.flatten(), np.float64), np.asarray(v.value_lengths().fill_null(0), np.int64)
    width = int(ends.max(initial=0))
    if len(flat) == width * len(ends):
        return flat.reshape(len(ends), width)
    out = np.zeros((len(ends), width))
    out[np.repeat(np.arange(len(ends)), ends), np.arange(len(flat)) - np.repeat(np.cumsum(ends) - ends, ends)] = flat
    return out


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest integer inner products for each query.

    vectors: vec_id, embedding. Components become floor(scale * x). Rows with a null id, a null vector or
    a null or non-finite component (also once scaled) take no part. Every row is a candidate but the query's own: of rows that
    repeat an id each is a candidate, and a query of its own. Ties go to the smaller vec_id. Vectors of
    unequal length are compared as if padded with zeros; an empty table gives no rows; extra columns are
    ignored. Scores are exact; one beyond 64 bits is ranked as it is (those equal as doubles tie) and returned as the nearest long. is_query: a
    condition over vec_id.
    """
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"))
    sound = F.col("e").isNotNull() & ~F.exists("e", lambda x: x.isNull() | F.isnan(x) | (F.abs(x * scale) == float("inf")))
    v = v.where(F.col("vec_id").isNotNull()).where(F.coalesce(sound, F.lit(False)))
    v = v.select(F.monotonically_increasing_id().alias("row"), "vec_id", F.transform("e", lambda x: F.when(F.abs(x * scale) < 2.0**52, F.floor(x * scale).cast("double")).otherwise(x * scale)).alias("v"))
    tasks = max(1, -(-vectors.count() // TASK))
    v = stored(v.repartition(tasks, "row"))
    queries = v.where(is_query)
    passes = max(1, -(-int(queries.agg(F.sum(8 * F.size("v") + 16)).first()[0] or 0) // pass_bytes))
    spark, found = v.sparkSession, []
    for p in range(passes):
        t = queries.where(F.pmod(F.xxhash64("row", F.lit(3)), F.lit(passes)) == p).toArrow().combine_chunks()
        if not t.num_rows:
            continue
        shared = spark.sparkContext.broadcast((np.asarray(t["row"]), np.asarray(t["vec_id"]), _matrix(t["v"].combine_chunks())))

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            keys, names, q = shared.value
            s = Search(keys, q, k)
            for b in batches:
                if b.num_rows:
                    s.add(np.asarray(b["row"]), np.asarray(b["vec_id"]), _matrix(b["v"]))
            n = [len(i) for i, _ in s.best]
            if sum(n):
                ids, scores = np.concatenate([i for i, _ in s.best]), np.concatenate([x for _, x in s.best])
                over, kept = _held(scores)
                yield pa.RecordBatch.from_arrays([np.repeat(keys, n), np.repeat(names, n), ids, over, kept], names=["row", "query_id", "vec_id", "over", "score"])

        found.append(stored(v.mapInArrow(search, "row long, query_id long, vec_id long, over double, score long")))
        shared.destroy()
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    drop_stored(v)
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    w = Window.partitionBy("row").orderBy(F.col("over").desc(), F.col("score").desc(), F.col("vec_id").asc())
    return every.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _held(scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores as longs, and for those that don't fit their approximate value, else 0."""
    if scores.dtype != object:
        return np.zeros(len(scores)), scores.astype(np.int64)
    over, kept = np.zeros(len(scores)), np.zeros(len(scores), np.int64)
    for i, x in enumerate(scores):
        kept[i] = min(max(x, -(2**63)), 2**63 - 1)
        if kept[i] != x:
            over[i] = float(x) if abs(x) < 10**308 else (np.inf if x > 0 else -np.inf)
    return over, kept


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


OP5_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
g AS (
  SELECT r, vec_id, list_transform(e, lambda x: CAST(floor(256 * x) AS DOUBLE)) AS v FROM v
  WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.r AS r, q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM g q JOIN g c ON q.r <> c.r WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM s) t
WHERE rank <= 5
"""
