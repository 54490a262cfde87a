"""Quality rules: a linear-chain conditional random field marks each line content or boilerplate.

Viterbi decoding labels the lines of a document; it is retained when lines with enough of its words
are content and it passes the base rules. The field is fitted on a bounded sample of labelled
documents (TRAIN_ROWS rows of `labels`). `labels` tells good from bad documents, not lines; line labels
come from it in rounds. At first every line has its document's label, but lines that stand in several
documents which have little else in common are boilerplate anywhere. After each round lines of bad
documents that look like content count as content, and lines of good ones that look like those of bad ones as boilerplate,
so chains change labels inside a document and transitions are learned from that.
"""

from __future__ import annotations

from collections import defaultdict
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumora.llm import crf
from lumora.llm.common import SPACES, as_bytes, map_batches, sample_of_labels, table

#: Labelled rows that the field is fitted on, at most.
TRAIN_ROWS = 4000
#: Lines of a training chain (longer documents give several), and chains at most.
SEGMENT, SEGMENTS = 64, 12_000
#: A line in at least so many unlike chains is boilerplate; unlike chains share less than this part of their other lines.
REPEATED, UNLIKE = 5, 0.2
#: Rounds of training, and how sure the field must be to give a line another label than its document's.
ROUNDS, CERTAIN = 3, 0.9
#: Share of the words that must lie in content lines.
CONTENT_SHARE = 0.5
SYMBOLS = b"#*$%&|<>"
_UPPER = bytes(range(65, 91))
_DIGITS = b"0123456789"
#: Number of values of each line feature.
_SIZES = (5, 4, 4, 2, 3, 2, 4, 4, 4, 2)
_BASE = np.concatenate([[1], 1 + np.cumsum(_SIZES)[:-1]])
N_FEATURES = 1 + int(sum(_SIZES))


class Base(NamedTuple):
    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int

    @property
    def failed(self) -> bool:
        return self.n_words < 50 or 100 * self.n_repeat_words > 50 * self.n_words


def repeat_words(words: list[bytes]) -> int:
    """Words covered by three-word windows that occur twice or more in the text, the first ones included."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict[bytes, int] = {}
    x = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    if len(ids) == n:
        return 0
    v = len(ids)
    pair = x[:-1] * v + x[1:]
    if v > 1_000_000:  # keep the triple below 2**63
        pair = np.unique(pair, return_inverse=True)[1].astype(np.int64)
    key = pair[:-1] * v + x[2:]
    order = np.argsort(key, kind="stable")
    s = key[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : n - 2 + k] |= twice
    return int(covered.sum())


def _bin(x: float, *edges: float) -> int:
    return sum(x >= e for e in edges)


class Model(NamedTuple):
    weights: np.ndarray
    transitions: np.ndarray
    repeated: frozenset[int]  # hashes of lines that are boilerplate anywhere


def line_hash(line: bytes) -> int:
    return xxhash.xxh3_64_intdigest(line.strip())


def measure(text: bytes, notices: frozenset[int] = frozenset()) -> tuple[Base, list[tuple[int, ...]], list[int]]:
    """The base figures, the feature codes of each line that has a word, and the words in those lines."""
    words = text.split()
    n = len(words)
    chars = len(text.decode("utf-8", "surrogatepass")) - sum(text.count(bytes([c])) for c in SPACES)
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    repeated = repeat_words(words)
    whole = _bin(repeated / n if n else 0.0, 0.1, 0.3, 0.5)
    codes, sizes, seen, dups = [], [], set(), 0
    for line in text.split(b"\n"):
        own = line.split()
        if not own:
            continue
        dup = line in seen
        dups += dup
        seen.add(line)
        k, size = len(own), max(1, len(line))
        upper = (size - len(line.translate(None, _UPPER))) / size
        marks = (size - len(line.translate(None, SYMBOLS))) / size
        digits = (size - len(line.translate(None, _DIGITS))) / size
        distinct = len(set(own)) / k
        mean = size / k
        codes.append((_bin(k, 2, 4, 11, 51), _bin(marks, 0.005, 0.03, 0.1), _bin(upper, 0.1, 0.3, 0.6), int(dup), _bin(digits, 0.05, 0.3), int(line.rstrip()[-1:] in (b".", b"!", b"?")), _bin(distinct, 0.35, 0.6, 0.85), _bin(mean, 3.5, 8, 14), whole, int(bool(notices) and line_hash(line) in notices)))
        sizes.append(k)
    return Base(n, chars, symbols, dups, repeated), codes, sizes


def repeated_lines(chains: list[np.ndarray]) -> frozenset[int]:
    """Hashes that stand in REPEATED or more chains, each unlike the others; copies and near copies count once.

    chains: line hashes. A chain of one line has nothing to tell it from others, and counts for nothing.
    """
    sets, where = [], defaultdict(list)
    for x in {tuple(c.tolist()) for c in chains}:
        own = set(x)
        if len(own) > 1:
            sets.append(own)
    sets.sort(key=lambda s: (-len(s), min(s)))
    for i, own in enumerate(sets):
        for h in own:
            where[h].append(i)
    out = set()
    for h, at in where.items():
        if len(at) < REPEATED:
            continue
        apart: list[set[int]] = []
        for i in at:
            own = sets[i] - {h}
            if all(len(own & x) < UNLIKE * min(len(own), len(x)) for x in apart):
                apart.append(own)
                if len(apart) == REPEATED:
                    out.add(h)
                    break
    return frozenset(out)


def fit_chains(chains: list[tuple[np.ndarray, np.ndarray, int]]) -> Model:
    """(feature codes [lines, features], line hashes, label of the document) of each chain. Without labels of both kinds all lines count as content."""
    good = sum(y for _, _, y in chains)
    bad = len(chains) - good
    if not good or not bad:
        return Model(np.zeros(N_FEATURES), np.log(np.full((2, 2), 0.5)), frozenset())
    repeated = repeated_lines([h for _, h, _ in chains])
    lengths = np.array([len(x) for x, _, _ in chains])
    known = np.isin(np.concatenate([h for _, h, _ in chains]), np.array(sorted(repeated), np.uint64))
    x = np.concatenate([c for c, _, _ in chains]).astype(np.int64)
    x[:, -1] = known
    x += _BASE
    own = np.repeat([y for _, _, y in chains], lengths)
    weight = np.repeat([(0.5 / good if y else 0.5 / bad) * len(chains) / len(c) for c, _, y in chains], lengths)
    labels = np.where(known, 0, own)
    for _ in range(ROUNDS):
        w, a = crf.train(x, labels, lengths, N_FEATURES, epochs=60, rate=0.3, weight=weight)
        p = crf.marginals(w[x].sum(axis=1), lengths, a)
        labels = np.where(known, 0, np.where(own == 1, p > 1 - CERTAIN, p > CERTAIN)).astype(int)
    return Model(w, a, repeated)


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Learns from at most `rows` labelled documents, whose whole texts executors read.

    Feature codes and line hashes come to the driver: of at most SEGMENTS chains of SEGMENT lines, those of the smallest hashes.
    """
    sample = sample_of_labels(labels, "quality", rows)
    chosen = docs.select(F.col("doc_id"), "text").join(F.broadcast(sample), "doc_id").select("text", "label")

    def cut(b: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for t, y in zip(as_bytes(b.column("text")), b.column("label").to_pylist(), strict=True):
            codes = np.asarray(measure(t)[1], np.int8).reshape(-1, len(_SIZES))
            hashes = np.array([line_hash(x) for x in t.split(b"\n") if x.split()], np.uint64)
            out += [(codes[i : i + SEGMENT].tobytes(), hashes[i : i + SEGMENT].tobytes(), int(y > 0)) for i in range(0, len(codes), SEGMENT)]
        c, h, y = zip(*out, strict=True) if out else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(c, pa.binary()), pa.array(h, pa.binary()), pa.array(y, pa.int32())], names=["codes", "hashes", "label"])

    every = map_batches(chosen, cut, "codes binary, hashes binary, label int").orderBy(F.xxhash64("hashes", "codes"), "hashes", "codes", "label").limit(SEGMENTS)
    return fit_chains([(np.frombuffer(r["codes"], np.int8).reshape(-1, len(_SIZES)), np.frombuffer(r["hashes"], np.uint64), r["label"]) for r in every.collect()])


def judge(docs: DataFrame, model: Model, share: float = CONTENT_SHARE) -> DataFrame:
    """All columns of docs, then n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, content_share, kept.

    A null or empty text has no words and fails the base rules; a document whose lines were never seen
    in training is content where the weights don't tell. One row for each row of docs, repeated ones
    judged alike, texts of any length read whole, an empty table giving none. Columns of docs with these names are replaced.
    """
    w, a, repeated = model
    potential = {}
    added = [("n_words", "long"), ("word_chars", "long"), ("n_symbols", "long"), ("n_dup_lines", "long"), ("n_repeat_words", "long"), ("base_failed", "boolean"), ("content_share", "double"), ("kept", "boolean")]
    names = {n for n, _ in added}
    own = [c for c in docs.columns if c.lower() not in names]
    docs = docs.select(*[F.col(f"`{c}`") for c in own])
    at = [c.lower() for c in own].index("text")

    def line(code: tuple[int, ...]) -> float:
        u = potential.get(code)
        if u is None:
            u = potential[code] = float(w[np.asarray(code) + _BASE].sum())
        return u

    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for text in as_bytes(b.column(at)):
            base, codes, sizes = measure(text, repeated)
            y = crf.viterbi([line(c) for c in codes], a)
            content = sum(n for n, v in zip(sizes, y, strict=True) if v) / max(1, base.n_words)
            rows.append((*base, base.failed, content, not base.failed and content >= share))
        cols = zip(*rows, strict=True)
        kinds = {"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}
        new = [pa.array(c, kinds[k]) for c, (_, k) in zip(cols, added, strict=True)]
        return pa.RecordBatch.from_arrays([*b.columns, *new], names=[*b.schema.names, *(n for n, _ in added)])

    from pyspark.sql.types import StructType

    schema = StructType(list(docs.schema.fields))
    for name, kind in added:
        schema = schema.add(name, kind)
    return map_batches(docs, one, schema)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return judge(docs, model).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_share")
