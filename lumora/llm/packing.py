"""Packing: deficit round-robin over source queues fills windows to target token proportions.

Each source is a queue, the stream of its documents' tokens in table order. A round gives every queue
a quantum, its target share of a window's tokens; a queue serves documents while its deficit counter
is above zero, and pays their tokens. What it took too much or too little is carried from round to
round, so after any number of windows a queue has had its share but for a round's quantum and one document.
Documents follow each other in the order of service and are cut only where a window ends.

So that many tasks can pack, all queues are cut into the same number of lanes, each with an equal part
of every queue (from a place that depends on the source, so that sources of few documents are spread).
A document belongs to the lane in which its first token lies. By how far the last document of
the lane before reaches into this one is known from the first document's place: that is the deficit
which the queue carries from lane to lane. Lanes are small, so a task holds little; each ends with one window to be padded.

The tokens are counted in a first pass, which stores the ids; they are shuffled once, to their lanes.
"""

from __future__ import annotations

import base64
import heapq
import re
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumora.llm.common import stored, table

LENGTH, END = 2048, 1
#: Windows a lane, about.
LANE = 1024
#: Up to so many (partition, queue) rows are broadcast; beyond, they are joined by shuffle.
BROADCAST_ROWS = 100_000
#: Lanes that a task packs, about, one after another, and tasks at most.
LANES_A_TASK, TASKS = 2, 50_000
_FAR = re.compile("[\u0250-\U0010ffff]")


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


class Encoder:
    """Ids of a byte-level BPE vocabulary file, as little-endian unsigned 16-bit numbers.

    Of two libraries that read the same vocabulary the faster one takes texts whose characters both
    class alike (those below U+0250) and that hold no special token; the other one takes all others.
    """

    def __init__(self, json_path: str, ranks_path: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(json_path)
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(ranks_path).read_bytes().splitlines())}
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]

    def encode(self, text: str) -> bytes:
        if (text.isascii() or not _FAR.search(text)) and not any(s in text for s in self.special):
            ids = self.fast.encode_ordinary(text)
        else:
            ids = self.whole.encode(text, add_special_tokens=False).ids
        return np.asarray(ids, "<u2").tobytes()


def served(queues: list[tuple[int, int, list[int]]], whole: int, length: int) -> list[tuple[int, int]]:
    """(queue, document) in the order of service by deficit round-robin.

    queues: (weight, tokens carried, sizes of the documents); a queue's target share is weight / whole.
    Counters hold tokens times `whole`, so they are exact. Rounds in which a queue has nothing to
    serve are leapt over. Queues of weight 0 come last.
    """
    out, heap = [], []
    at = [0] * len(queues)
    for s, (weight, carried, sizes) in enumerate(queues):
        if weight > 0 and sizes:
            d, quantum = carried * whole, weight * length
            k = max(1, -d // quantum + 1)
            heap.append((k, s, d + k * quantum))
    heapq.heapify(heap)
    while heap:
        k, s, d = heapq.heappop(heap)
        weight, _, sizes = queues[s]
        i, quantum = at[s], weight * length
        while d > 0 and i < len(sizes):
            out.append((s, i))
            d -= sizes[i] * whole
            i += 1
        at[s] = i
        if i < len(sizes):
            more = -d // quantum + 1
            heapq.heappush(heap, (k + more, s, d + more * quantum))
    out += [(s, i) for s, q in enumerate(queues) if q[0] <= 0 for i in range(len(q[2]))]
    return out


def pieces(n: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(document index, start in the document, length, window, offset in it) of documents of n tokens each, one after another."""
    end = np.cumsum(n)
    start = end - n
    first, last = start // length, (end - 1) // length
    count = last - first + 1
    doc = np.repeat(np.arange(len(n)), count)
    w = first[doc] + np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    a, b = np.maximum(start[doc], w * length), np.minimum(end[doc], (w + 1) * length)
    return doc, a - start[doc], b - a, w, a - w * length


def encoded(docs: DataFrame, paths: tuple[str, str] | None = None) -> DataFrame:
    """doc_id, queue, n, ids, part, place: stored. place: tokens of the queue before this document in its partition."""
    json_path, ranks_path = paths or default_paths()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, places = Encoder(json_path, ranks_path), TaskContext.get().partitionId(), {}
        end = np.asarray([END], "<u2").tobytes()
        for b in batches:
            ids = [encoder.encode(t or "") + end for t in b.column("text").to_pylist()]
            n = [len(x) // 2 for x in ids]
            place = []
            for q, k in zip(b.column("queue").to_pylist(), n, strict=True):
                place.append(places.get(q, 0))
                places[q] = place[-1] + k
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("queue"), pa.array(n, pa.int64()), pa.array(ids, pa.binary()), pa.array([part] * len(n), pa.int32()), pa.array(place, pa.int64())], names=["doc_id", "queue", "n", "ids", "part", "place"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", queue_of(F.col("source")).alias("queue"))
    return stored(rows.mapInArrow(run, "doc_id long, queue string, n long, ids binary, part int, place long"))


def queue_of(source: Column) -> Column:
    """A queue's name: that of its source behind "=", or nothing for null."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def in_lanes(ids: DataFrame, length: int, lane: int, weights: dict[str | None, float] | None) -> tuple[DataFrame, int]:
    """ids with lane, weight and `carried` (tokens, where a document is its queue's first in the lane), and the sum of all weights."""
    sums = ids.groupBy("part", "queue").agg(F.sum("n").alias("tokens"))
    own = Window.partitionBy("queue")
    base = stored(sums.withColumn("base", F.sum("tokens").over(own.orderBy("part")) - F.col("tokens")).withColumn("of_queue", F.sum("tokens").over(own)))
    whole = base.agg(F.sum("tokens")).first()[0] or 0
    lanes = max(1, -(-whole // (lane * length)))
    weight = F.col("of_queue")
    if weights is not None:
        fixed = [("" if s is None else "=" + s, round(w * 2**20)) for s, w in weights.items()]
        whole = sum(w for _, w in fixed)
        given = F.create_map(*[F.lit(x) for pair in fixed for x in pair]) if fixed else F.lit(None).cast("map<string,bigint>")
        weight = F.coalesce(given[F.col("queue")], F.lit(0)).cast("long")
    table_ = base.select("part", "queue", "base", "of_queue", weight.alias("weight"))
    placed = ids.join(F.broadcast(table_) if base.count() <= BROADCAST_ROWS else table_, ["part", "queue"])
    shift = F.pmod(F.xxhash64("queue", F.lit(23)), F.col("of_queue"))
    placed = placed.withColumn("start", F.pmod(F.col("base") + F.col("place") + shift, F.col("of_queue")))
    width = F.col("of_queue") / F.lit(lanes)  # tokens of the queue a lane, not whole
    placed = placed.withColumn("lane", F.least(F.floor(F.col("start") / width).cast("long"), F.lit(lanes - 1)))
    carried = (F.floor(F.col("lane") * width) - F.col("start")).cast("long")
    placed = placed.select("lane", "queue", "weight", "start", carried.alias("carried"), "doc_id", "n", "ids")
    return placed.repartition(min(TASKS, -(-lanes // LANES_A_TASK)), "lane"), whole


def pack(docs: DataFrame, length: int = LENGTH, paths: tuple[str, str] | None = None, weights: dict[str | None, float] | None = None, lane: int = LANE) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: one row a piece.

    docs: doc_id, text, source; other columns are ignored. A null text is empty: its one token is the
    end. Null sources are a queue of their own. Repeated rows are packed as often as they occur. No
    rows give no pieces. Sequences have `length` tokens, but the last one of a lane, which is to be
    padded; they are numbered by lane times 2**32 and within it. weights: target share of each source, in any
    unit; sources without one are packed after the others. By default each source's share of all
    tokens, so that all queues end together.
    """
    placed, whole = in_lanes(encoded(docs, paths), length, lane, weights)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def one(t: pa.Table) -> pa.Table:
        t = t.sort_by([("queue", "ascending"), ("start", "ascending")]).combine_chunks()
        n, number = np.asarray(t["n"], np.int64), t["lane"][0].as_py()
        name = t["queue"].combine_chunks().dictionary_encode()
        code = np.asarray((name.chunk(0) if isinstance(name, pa.ChunkedArray) else name).indices)
        first = np.flatnonzero(np.diff(code, prepend=-1)).tolist()
        weight, carried = t["weight"].to_pylist(), t["carried"].to_pylist()
        size = n.tolist()
        queues = [(weight[a], carried[a], size[a:b]) for a, b in zip(first, [*first[1:], len(size)], strict=True)]
        order = np.array([first[s] + i for s, i in served(queues, whole, length)], np.int64)
        doc, at, k, w, offset = pieces(n[order], length)
        crc, raw, now, column = [], b"", -1, t["ids"]
        for d, a, m in zip(order[doc].tolist(), (4 * at).tolist(), (4 * k).tolist(), strict=True):
            if d != now:
                now, raw = d, memoryview(np.frombuffer(column[d].as_py(), "<u2").astype("<u4").tobytes())
            crc.append(zlib.crc32(raw[a : a + m]))
        return pa.Table.from_arrays([t["doc_id"].take(pa.array(order[doc])), *(pa.array(x, pa.int64()) for x in (at, k, crc, n[order[doc]], number * 2**32 + w, offset))], names=names)

    return placed.groupBy("lane").applyInArrow(one, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
