"""Toxicity: a linear-chain conditional random field tags toxic words; its marginals score documents.

`labels.toxic` marks documents, not words. Word labels come from it: a word of a toxic document is
toxic when the word or one of its leading parts is far more frequent among toxic documents than
among the others. The field learns from these labels over whole documents, so that words it has
never seen are tagged by their parts and their neighbours. Forward-backward gives each word its
probability; the largest, the expected number and the length of the document make its score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumora.llm import crf
from lumora.llm.common import as_bytes, drop_stored, fold_column, map_batches, sample_of_labels, stored, table

#: Labelled rows that the model is fitted on, at most; of their texts, of any length, segments of SEGMENT words train the
#: field, at most SEGMENTS of those with marked words and as many of the others; parts that are features, at most.
TRAIN_ROWS, SEGMENT, SEGMENTS, PARTS = 2500, 128, 6000, 200_000
#: Characters of a word that its parts show.
SHOWN = 40
#: Words whose potentials a task remembers, at most.
CACHE = 300_000
#: A part marks toxic words when it is this many times as frequent in toxic documents and the
#: log-likelihood ratio against chance (G squared) is at least this; parts in fewer documents are not features.
RATIO, CHANCE, LEAST = 8.0, 18.0, 3
_EDGES = b".,;:!?\"'()[]{}*#$%&<>|-_"
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def parts(word: bytes) -> tuple[str, ...]:
    """Features of a lower-case word: itself, its leading parts of 3 to 6 letters, its last 3, all of its first SHOWN characters."""
    w = word.strip(_EDGES)[: 4 * SHOWN].decode("utf-8", "replace")[:SHOWN]
    if not w:
        return ("=",)
    return ("=" + w, *(f"{k}<{w[:k]}" for k in (3, 4, 5, 6) if len(w) > k), ">" + w[-3:])


def _surprise(c1: int, c0: int, share: float) -> float:
    """G squared of c1 toxic and c0 other documents when `share` of all are toxic."""
    c = c1 + c0
    return 2 * sum(k * math.log(k / (c * q)) for k, q in ((c1, share), (c0, 1 - share)) if k)


class Model(NamedTuple):
    weights: dict[str, float]
    bias: float
    transitions: np.ndarray
    head: np.ndarray  # intercept; largest marginal; log1p of their sum; their sum by word; log1p of the words


class Tagger:
    """Word potentials with a bounded memory."""

    def __init__(self, model: Model):
        self.model, self.known = model, {}

    def potential(self, word: bytes) -> float:
        if len(self.known) >= CACHE:
            self.known.clear()
        m = self.model
        u = self.known[word] = m.bias + sum(m.weights.get(p, 0.0) for p in parts(word))
        return u

    def marginals(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        get, miss, flat, lengths = self.known.get, self.potential, [], []
        for t in texts:
            words = t.lower().split()
            lengths.append(len(words))
            for w in words:
                u = get(w)
                flat.append(miss(w) if u is None else u)
        n = np.asarray(lengths, np.int64)
        full = n[n > 0]
        return crf.marginals(np.asarray(flat), full, self.model.transitions), n


def summary(p: np.ndarray, n: np.ndarray) -> np.ndarray:
    """One row a document: 1, largest marginal, log1p of the sum, sum by word, log1p of the words."""
    out = np.zeros((len(n), 5))
    out[:, 0], out[:, 4] = 1, np.log1p(n)
    full = n > 0
    if full.any():
        at = np.concatenate([[0], np.cumsum(n[full])[:-1]])
        total = np.add.reduceat(p, at)
        out[full, 1], out[full, 2], out[full, 3] = np.maximum.reduceat(p, at), np.log1p(total), total / n[full]
    return out


def _logistic(x: np.ndarray, y: np.ndarray, steps: int = 600) -> np.ndarray:
    w, square = np.zeros(x.shape[1]), np.full(x.shape[1], 1e-8)
    for _ in range(steps):
        g = x.T @ (y - crf.sigmoid(x @ w)) / len(y) - 1e-4 * w
        square += g * g
        w += 0.5 * g / np.sqrt(square)
    return w


def _one_kind(n: int, n1: int) -> Model:
    rate = (n1 + 0.5) / (n + 1)
    return Model({}, -10.0, np.zeros((2, 2)), np.array([math.log(rate / (1 - rate)), 0, 0, 0, 0.0]))


def part_counts(rows: Iterable[tuple[bytes, int]]) -> tuple[Counter, Counter]:
    """In how many texts labelled 0 and 1 each part occurs."""
    made: dict[bytes, tuple[str, ...]] = {}
    df = (Counter(), Counter())
    for text, y in rows:
        found = set()
        for w in set(text.lower().split()):
            if (ps := made.get(w)) is None:
                ps = made[w] = parts(w)
                if len(made) > CACHE:
                    made.clear()
            found.update(ps)
        df[y > 0].update(found)
    return df


def marks_of(df: tuple[Counter, Counter], n0: int, n1: int) -> frozenset[str]:
    """The parts that mark a word of a toxic text as toxic."""
    return frozenset(p for p, c in df[1].items() if c / n1 >= RATIO * (df[0][p] + 0.5) / n0 and _surprise(c, df[0][p], n1 / (n1 + n0)) >= CHANCE and not p.startswith(">"))


def segments(text: bytes, y: int, marks: frozenset[str]) -> Iterator[tuple[bytes, bool, bool]]:
    """(words, label of the text, whether a word is marked): a text in segments; of a toxic one without a mark there are none."""
    words = text.lower().split()
    cut = [words[at : at + SEGMENT] for at in range(0, len(words), SEGMENT)]
    hit = [bool(y) and any(not marks.isdisjoint(parts(w)) for w in set(x)) for x in cut]
    if not y or any(hit):
        yield from ((b" ".join(x), y > 0, h) for x, h in zip(cut, hit, strict=True))


def field_of(df: tuple[Counter, Counter], marks: frozenset[str], used: list[tuple[bytes, bool]]) -> Model:
    """The field, fitted on (segment, label of its text), without the head."""
    total = df[0] + df[1]
    ranked = sorted((p for p in total if total[p] >= LEAST), key=lambda p: (-total[p], p))[:PARTS]
    keep = {p: i + 2 for i, p in enumerate(sorted(ranked))}
    slots = 6
    # every other segment shows its words by their short leading parts only, as if they were new
    codes: tuple[dict[bytes, list[int]], dict[bytes, list[int]]] = ({}, {})
    marked: dict[bytes, bool] = {}
    cut = [(x.split(), y) for x, y in used]
    for w in {w for x, _ in cut for w in x}:
        ps = parts(w)
        for k, shown in enumerate((ps, [p for p in ps if p[:2] in ("3<", "4<")])):
            ids = [1, *(keep[p] for p in shown if p in keep)][: slots + 1]
            codes[k][w] = ids + [0] * (slots + 1 - len(ids))
        marked[w] = not marks.isdisjoint(ps)
    x = np.array([codes[i % 2][w] for i, (words, _) in enumerate(cut) for w in words], np.int32).reshape(-1, slots + 1)
    y = np.array([y and marked[w] for words, y in cut for w in words])
    weights, a = crf.train(x, y, np.array([len(words) for words, _ in cut]), len(keep) + 2, epochs=40, rate=0.3)
    return Model({p: float(weights[i]) for p, i in keep.items() if abs(weights[i]) > 1e-3}, float(weights[1]), a, np.zeros(5))


def fit_rows(rows: list[tuple[bytes, int]]) -> Model:
    """fit() for (text, label) rows in memory. With one kind of label only, the score is its share."""
    n1 = sum(y > 0 for _, y in rows)
    n0 = len(rows) - n1
    if not n1 or not n0:
        return _one_kind(len(rows), n1)
    df = part_counts(rows)
    marks = marks_of(df, n0, n1)
    model = field_of(df, marks, [(x, y) for t, label in rows for x, y, _ in segments(t, label, marks)])
    p, n = Tagger(model).marginals([t for t, _ in rows])
    return model._replace(head=_logistic(summary(p, n), np.array([y > 0 for _, y in rows], float)))


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Learns from at most `rows` labelled documents whose crc32(doc_id) mod 5 is not 0.

    Whole texts are counted, cut and summed up by executors. To the driver come counts of at most PARTS
    parts, at most 2 * SEGMENTS segments of SEGMENT words and five numbers a document. Null texts are empty ones.
    """
    sample = sample_of_labels(labels, "toxic", rows, skip_fold=0)
    chosen = stored(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select(F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"), F.col("label").cast("int").alias("label")))
    n, n1 = chosen.agg(F.count("*"), F.count(F.when(F.col("label") > 0, 1))).first()
    if not n1 or n1 == n:
        return _one_kind(n, n1)

    def labelled(b: pa.RecordBatch) -> list[tuple[bytes, int]]:
        return list(zip(as_bytes(b.column("text")), b.column("label").to_pylist(), strict=True))

    def counted(b: pa.RecordBatch) -> pa.RecordBatch:
        c0, c1 = part_counts(labelled(b))
        names = list(c0.keys() | c1.keys())
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([c0[p] for p in names], pa.int64()), pa.array([c1[p] for p in names], pa.int64())], names=["part", "c0", "c1"])

    sums = map_batches(chosen, counted, "part string, c0 long, c1 long").groupBy("part").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1"))
    got = sums.where(F.col("c0") + F.col("c1") >= LEAST).orderBy((-F.col("c0") - F.col("c1")), "part").limit(PARTS).collect()
    df = (Counter({r["part"]: r["c0"] for r in got}), Counter({r["part"]: r["c1"] for r in got}))
    marks = marks_of(df, n - n1, n1)

    def cut(b: pa.RecordBatch) -> pa.RecordBatch:
        out = [s for t, y in labelled(b) for s in segments(t, y, marks)]
        x, y, hit = zip(*out, strict=True) if out else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(x, pa.binary()), pa.array(y, pa.bool_()), pa.array(hit, pa.bool_())], names=["x", "y", "hit"])

    every = stored(map_batches(chosen, cut, "x binary, y boolean, hit boolean"))
    order = [F.xxhash64("x"), "x", "y"]
    used = [(bytes(r["x"]), r["y"]) for hit in (True, False) for r in every.where(F.col("hit") == hit).orderBy(*order).limit(SEGMENTS).select("x", "y").collect()]
    model = field_of(df, marks, used)

    def summed(b: pa.RecordBatch) -> pa.RecordBatch:
        x = summary(*Tagger(model).marginals(as_bytes(b.column("text"))))
        return pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), b.column("label").cast(pa.int32())], names=["x", "label"])

    heads = sorted((tuple(r["x"]), r["label"]) for r in map_batches(chosen, summed, "x array<double>, label int").collect())
    drop_stored(chosen, every)
    return model._replace(head=_logistic(np.array([x for x, _ in heads]), np.array([y > 0 for _, y in heads], float)))


def score(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """doc_id, score (0 to 1), spans: one row for each row of docs.

    spans: [start, end) character offsets of words whose marginal is at least `least`. Only the text
    matters; null and empty texts get the score of a text without words. Repeated rows are scored each and alike, texts
    of any length are read whole, an empty table gives no rows, and other columns of docs are ignored.
    """

    shared = docs.sparkSession.sparkContext.broadcast(model)
    tagger: list[Tagger] = []

    def start() -> None:
        tagger[:] = [Tagger(shared.value)]

    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        texts = as_bytes(b.column("text"))
        p, n = tagger[0].marginals(texts)
        value = crf.sigmoid(summary(p, n) @ shared.value.head)
        hit = p >= least
        ends = np.cumsum(n)
        spans = []
        for i, t in enumerate(texts):
            own = hit[ends[i] - n[i] : ends[i]]
            spans.append([])
            if own.any():
                words = list(_WORD.finditer(t))
                for k in np.flatnonzero(own):
                    s = len(t[: words[k].start()].decode("utf-8", "replace"))
                    spans[-1].append({"start": s, "end": s + len(words[k][0].decode("utf-8", "replace"))})
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        return pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(value), pa.array(spans, kind)], names=["doc_id", "score", "spans"])

    return map_batches(docs.select("doc_id", "text"), one, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double, spans array<struct<start:int,end:int>>", start)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (fold_column() == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.to_json("spans").alias("spans"))
