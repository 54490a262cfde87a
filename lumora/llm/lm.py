"""LM scoring: a gated recurrent network over words, with a class-factored softmax.

P(word | state) = P(class | state) * P(word | class, state). The most frequent words (VOCABULARY of
them) are dealt to classes of CLASS words; the others fall into SHAPES classes by their letters, in
which a word's share follows its count in the whole training corpus. All counts cover all training
documents; the network's weights are fitted, by truncated backpropagation, on all of them too, each
read once. Every task trains a copy of the weights on the documents that it reads, in rounds; after a
round the copies are averaged in a tree. Documents are scored whole: the state goes on from window to
window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumora.llm.common import fold_column, map_batches, stored, table, tokens

END = b"\n"  # no word: words have no white space
VOCABULARY, CLASS, SHAPES, HIDDEN, WINDOW = 4096, 64, 16, 16, 32
#: Words whose counts are broadcast, at most, and the bytes of the longest among them; the counts of all others are joined.
HEAD, HEAD_BYTES = 131_072, 64
#: Training goes in rounds, which read other rows each and together every row of the training documents.
ROUNDS = 2
#: Copies of the weights that are averaged at once.
FAN = 32
#: Documents that a trainer reads side by side; longer ones than SEGMENT words are read in segments, side by side too.
STREAMS, SEGMENT = 128, 1024
#: Rows that are scored side by side, and words whose outputs are worked out at once.
ROWS, OUTPUTS = 2500, 32_768
#: Rows of a softmax that are worked out at once: they stay in a processor's own cache.
BLOCK = 1024
ONE, HALF = np.float32(1), np.float32(0.5)

_DE, _ES, _FR = (frozenset(s) for s in ("äöüß", "ñíóáú", "éèêëàçùûîïôâ"))


def shape(word: bytes) -> int:
    """The class, 0 to SHAPES - 1, of a word that isn't in the vocabulary."""
    if not word.isascii():
        s = set(word.decode("utf-8", "replace"))
        return 0 if s & _DE else 1 if s & _ES else 2 if s & _FR else 3
    w = word.strip(b".,;:!?\"'()-")
    if not w.isalpha():
        return 4 if any(48 <= c <= 57 for c in w) else 5
    return 6 + (w[-1] * 31 + (w[-2] if len(w) > 1 else 0) * 7) % (SHAPES - 6)


def shapes(words: pa.Array) -> np.ndarray:
    """shape() of every word, by whole columns."""
    words = words.cast(pa.large_binary())
    odd = np.flatnonzero(~np.asarray(pc.string_is_ascii(words.cast(pa.large_string(), safe=False)), bool))
    bare = pc.ascii_trim(words.cast(pa.large_string(), safe=False), characters=".,;:!?\"'()-")
    ends = np.frombuffer(bare.buffers()[1], np.int64)[bare.offset : bare.offset + len(bare) + 1]
    n, raw = np.diff(ends), np.frombuffer(bare.buffers()[2] or b"", np.uint8)
    last, before = np.zeros(len(bare), np.int64), np.zeros(len(bare), np.int64)
    last[n > 0], before[n > 1] = raw[ends[1:][n > 0] - 1], raw[ends[1:][n > 1] - 2]
    other = np.where(np.asarray(pc.match_substring_regex(bare, "[0-9]"), bool), 4, 5)
    out = np.where(np.asarray(pc.ascii_is_alpha(bare), bool), 6 + (last * 31 + before * 7) % (SHAPES - 6), other)
    out[odd] = [shape(w) for w in words.take(pa.array(odd)).to_pylist()]
    return out.astype(np.int32)


def counted(docs: DataFrame, held_out: int = 1) -> DataFrame:
    """word, shape, c: a row a word of the training documents, stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                words, n = tokens(b.column("text"))
                words = words.dictionary_encode()
                c = np.bincount(np.asarray(words.indices), minlength=len(words.dictionary))
                names = pa.concat_arrays([words.dictionary.cast(pa.large_binary()).cast(pa.binary()), pa.array([END], pa.binary())])
                yield pa.RecordBatch.from_arrays([names, pa.array(np.append(c, len(n)), pa.int64())], names=["word", "c"])

    def shaped(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*b.columns, pa.array(shapes(b.column("word")))], names=["word", "c", "shape"])

    rows = docs.where(fold_column() != held_out).select("text").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))
    return stored(map_batches(rows, shaped, "word binary, c long, shape int"))


class Vocabulary:
    """The broadcast part of the counts; input numbers from VOCABULARY on are shapes."""

    def __init__(self, head: list[tuple[bytes, int, int]], facts: dict, shapes: dict[int, tuple[int, int]]):
        """head: (word, shape, c), most frequent first. shapes: (sum of c, words with c > 0) over the whole corpus."""
        top = sorted(head[:VOCABULARY], key=lambda r: (r[1], -r[2], r[0]))
        self.classes = VOCABULARY // CLASS
        #: the head's words, their input numbers, and their counts
        self.words = [w for w, _, _ in head]
        number = {w: i for i, (w, _, _) in enumerate(top)}
        self.number = np.array([number.get(w, VOCABULARY + s) for w, s, _ in head] or [0], np.int32)
        self.count = np.array([c for _, _, c in head] or [0], np.float64)
        self.counts = np.full(VOCABULARY, 1e-9)
        self.counts[: len(top)] = [c + 0.5 for _, _, c in top]
        sums = np.array([shapes.get(s, (0, 0)) for s in range(SHAPES)], float)
        for _, s, c in top:
            sums[s] -= (c, c > 0)
        #: log10 of what a shape's word counts, plus a half each, add up to, with one unknown word
        self.shape_mass = sums[:, 0] + 0.5 * (sums[:, 1] + 1)
        self.total, self.distinct = facts["total"] or 0, facts["distinct"] or 0


def vocabulary(counts: DataFrame) -> Vocabulary:
    """Ranks words by their counts in training documents; words of more than HEAD_BYTES bytes are left to the join."""
    facts = counts.agg(F.sum("c").alias("total"), F.count(F.when(F.col("c") > 0, 1)).alias("distinct")).first().asDict()
    octave = F.floor(8 * F.log2("c")).cast("int")
    short = counts.where((F.col("c") > 0) & (F.length("word") <= HEAD_BYTES)).select("word", "shape", "c", octave.alias("o"))
    seen, least, chosen = 0, None, short.limit(0)
    for o, k in sorted(((r["o"], r["k"]) for r in short.groupBy("o").agg(F.count("*").alias("k")).collect()), reverse=True):
        if seen + k > HEAD:
            if seen < VOCABULARY:  # of an octave that is too large for the head, what the vocabulary still needs
                chosen = short.where(F.col("o") == o).orderBy(F.desc("c"), "word").limit(VOCABULARY - seen)
            break
        least, seen = o, seen + k
    ends = short.where(F.col("word") == F.lit(END))  # always in the head
    rows = chosen.collect() + (short.where(F.col("o") >= least).collect() if least is not None else [])
    head = sorted({(bytes(r["word"]), r["shape"], r["c"]) for r in [*rows, *ends.collect()]}, key=lambda r: (-r[2], r[0]))
    shapes = {r["shape"]: (r["c"], r["v"]) for r in counts.groupBy("shape").agg(F.sum("c").alias("c"), F.count(F.when(F.col("c") > 0, 1)).alias("v")).collect()}
    return Vocabulary(head, facts, shapes)


def start_weights(v: Vocabulary, seed: int = 5) -> dict[str, np.ndarray]:
    """Weights that predict each word by its count, whatever the state."""
    rng = np.random.default_rng(seed)
    h, inputs, outs = HIDDEN, VOCABULARY + SHAPES, v.classes + SHAPES
    mass = np.concatenate([v.counts.reshape(v.classes, CLASS).sum(axis=1), v.shape_mass])
    w = {
        "g": rng.normal(0, 0.3, (inputs, 3 * h)),
        "u": rng.normal(0, 0.5 / np.sqrt(h), (h, 3 * h)),
        "wc": rng.normal(0, 0.01, (h, outs)),
        "bc": np.log(mass / mass.sum()),
        "wo": rng.normal(0, 0.01, (VOCABULARY, h)),
        "bo": np.log(v.counts),
    }
    w["g"][:, :h] += 1.0  # the state changes slowly
    return {k: x.astype(np.float32) for k, x in w.items()}


def _inputs(w: dict, x: np.ndarray) -> np.ndarray:
    """What inputs add to the two gates and the candidate, one after another; halved where the logistic function, as a tanh, wants half of it."""
    out = w["g"].reshape(-1, 3, HIDDEN).transpose(1, 0, 2).take(x, axis=1)
    out[:2] *= 0.5
    return out


def _recurrent(w: dict) -> np.ndarray:
    u = np.ascontiguousarray(w["u"].reshape(HIDDEN, 3, HIDDEN).transpose(1, 0, 2))
    u[:2] *= 0.5
    return u


def _step(u: np.ndarray, h: np.ndarray, g: np.ndarray, hu: np.ndarray, new: np.ndarray) -> None:
    """The next state from the last one, h, into new (which may be h), by _recurrent weights and _inputs.

    hu takes both gates and what the reset gate weighs; the last part of g becomes the candidate.
    """
    np.matmul(h, u, out=hu)
    gates, c = hu[:2], g[2]
    gates += g[:2]
    np.tanh(gates, out=gates)
    gates += ONE  # a scalar of the arrays' own type needs no cast
    gates *= HALF
    c += gates[1] * hu[2]
    np.tanh(c, out=c)
    np.subtract(h, c, out=new)
    new *= gates[0]
    new += c


def _starts(keys: np.ndarray) -> np.ndarray:
    """Where each of the sorted keys stands first."""
    first = np.ones(len(keys), bool)
    np.not_equal(keys[1:], keys[:-1], out=first[1:])
    return np.flatnonzero(first)


def _odds(weights: np.ndarray, states: np.ndarray, room: np.ndarray, safe: bool) -> tuple[np.ndarray, np.ndarray | None]:
    """exp(weights @ states) in room, by columns up to factors whose logs are given too, where not all of it is sure to be finite."""
    x, most = room[: len(weights) * states.shape[1]].reshape(len(weights), -1), None
    np.matmul(weights, states, out=x)
    if not safe:
        most = x.max(axis=0)
        x -= most
    return np.exp(x, out=x), most


def _outputs(w: dict, h: np.ndarray, x: np.ndarray, classes: int, grad: dict | None = None) -> np.ndarray:
    """log P of inputs x from states h, without shapes' own shares; with grad, adds to it and returns d(-log P)/dh instead.

    States lie between -1 and 1, so the sum of a row's absolute weights bounds what it adds to a bias.
    States are columns here. Odds are not divided by their sums: what is multiplied by them is, being shorter.
    """
    order = np.argsort(x.astype(np.int16), kind="stable")  # by class, too
    x, h = x.take(order), h.take(order, axis=0)
    cls = np.where(x < VOCABULARY, x // CLASS, classes + x - VOCABULARY)
    ends = np.searchsorted(cls, np.arange(classes + 1)).tolist()
    known = ends[classes]
    ones = np.empty((HIDDEN + 1, len(x)), h.dtype)  # the last row stands for the bias
    ones[:-1], ones[-1] = h.T, 1
    wo, wc, bo = w["wo"], np.ascontiguousarray(w["wc"].T), w["bo"].reshape(-1, CLASS)
    inner, outer = np.empty((len(wo), HIDDEN + 1), wo.dtype), np.empty((len(wc), HIDDEN + 1), wc.dtype)
    inner[:, :-1], inner[:, -1] = wo, (bo - bo.max(axis=1, keepdims=True)).ravel()
    outer[:, :-1], outer[:, -1] = wc, w["bc"] - w["bc"].max()
    each = np.ones(max(CLASS, HIDDEN, len(outer)), h.dtype)
    safe = max((np.abs(y) @ each[:HIDDEN]).max(initial=0) for y in (wo, wc)) < 40
    room = np.empty(BLOCK * max(CLASS, len(outer)), h.dtype)
    # outputs and the inputs that choose among them
    over = [(slice(0, len(outer)), slice(a, min(a + BLOCK, len(x)))) for a in range(0, len(x), BLOCK)]
    inside = [(slice(k * CLASS, (k + 1) * CLASS), slice(a, min(a + BLOCK, ends[k + 1]))) for k in range(classes) for a in range(ends[k], ends[k + 1], BLOCK)]
    if grad is None:
        # the scores themselves are taken apart, as an exp of them may have become 0
        out = np.einsum("ij,ij->i", h, wc.take(cls, axis=0)) + outer[:, -1].take(cls).astype(np.float64)
        out[:known] += np.einsum("ij,ij->i", h[:known], wo.take(x[:known], axis=0)) + inner[:, -1].take(x[:known])
        for weights, parts in ((outer, over), (inner, inside)):
            sums = np.ones(len(x), h.dtype)
            for own, rows in parts:
                p, most = _odds(weights[own], ones[:, rows], room, safe)
                np.matmul(each[: len(p)], p, out=sums[rows])
                if most is not None:
                    out[rows] -= most
            out -= np.log(sums)
    else:

        def expected(weights: np.ndarray, parts: list[tuple[slice, slice]], back: np.ndarray) -> np.ndarray:
            """The sums of states by outputs; back takes the weights that states expect."""
            d, values = np.zeros(weights.shape, h.dtype), np.ascontiguousarray(weights.T)
            values[-1] = 1
            for own, rows in parts:
                p, _ = _odds(weights[own], ones[:, rows], room, safe)
                t = back[:, rows]
                np.matmul(values[:, own], p, out=t)
                d[own] += p @ (ones[:, rows] / t[-1]).T
            back[:-1] /= back[-1]
            return d

        back, more = np.empty(ones.shape, h.dtype), np.empty((len(ones), known), h.dtype)
        d, at = expected(outer, over, back), _starts(cls)
        d[cls[at]] -= np.add.reduceat(ones, at, axis=1).T
        grad["wc"] += d[:, :-1].T
        grad["bc"] += d[:, -1]
        if known:
            d, at = expected(inner, inside, more), _starts(x[:known])
            d[x[at]] -= np.add.reduceat(ones[:, :known], at, axis=1).T
            grad["wo"] += d[:, :-1]
            grad["bo"] += d[:, -1]
            back[:-1, :known] += more[:-1]
        out = np.ascontiguousarray(back[:-1].T)
        out -= wc.take(cls, axis=0)
        out[:known] -= wo.take(x[:known], axis=0)
    inverse = np.empty(len(x), np.int64)
    inverse[order] = np.arange(len(x))
    return out.take(inverse, axis=0)


def train(w: dict[str, np.ndarray], docs: Iterator[np.ndarray], classes: int, rate: float = 0.1) -> int:
    """Truncated backpropagation in place; STREAMS documents at a time, the state carried on. Returns the tokens read."""
    square = {k: np.full(x.shape, 1e-6, np.float32) for k, x in w.items()}
    live: list[tuple[np.ndarray, int] | None] = [None] * STREAMS
    h, read, docs = np.zeros((STREAMS, HIDDEN), np.float32), 0, iter(docs)
    while True:
        for i in range(STREAMS):
            if live[i] is None or live[i][1] >= len(live[i][0]):
                nxt = next(docs, None)
                live[i] = None if nxt is None else (nxt, 0)
                h[i] = 0
        rows = [i for i in range(STREAMS) if live[i] is not None]
        if not rows:
            return read
        rows.sort(key=lambda i: live[i][1] - len(live[i][0]))  # windows get shorter, too
        window = [live[i][0][live[i][1] : live[i][1] + WINDOW] for i in rows]
        for i in rows:
            live[i] = (live[i][0], live[i][1] + WINDOW)
        lens = np.array(list(map(len, window)))
        length = int(lens[0])
        alive = np.searchsorted(-lens, -np.arange(length))
        by_time = np.zeros((len(rows), length), np.int64)
        by_time[np.arange(length) < lens[:, None]] = np.concatenate(window)
        flat = by_time.T[(np.arange(length) < lens[:, None]).T]
        ends, m, n_all = np.cumsum(alive).tolist(), HIDDEN, len(flat)
        inputs, u = _inputs(w, flat), _recurrent(w)
        states, kept = np.empty((n_all, m), np.float32), np.empty((3, n_all, m), np.float32)
        state = h[rows]
        for n, b in zip(alive.tolist(), ends, strict=True):
            a = b - n
            states[a:b] = state[:n]
            _step(u, state[:n], inputs[:, a:b], kept[:, a:b], state[:n])
        h[rows] = state
        grad = {k: np.zeros_like(x) for k, x in w.items() if k != "g"}
        dflat = _outputs(w, states, flat, classes, grad)
        z, r, past, c = *kept, inputs[2]
        # what a state's gradient is multiplied by for the update gate, the reset gate, what that weighs, and the candidate
        by = np.empty((4, n_all, m), np.float32)
        rest = 1 - z
        np.multiply((states - c) * z, rest, out=by[0])
        np.multiply(rest, 1 - c * c, out=by[3])
        np.multiply(by[3], r, out=by[2])
        np.multiply(by[2], past * (1 - r), out=by[1])
        back = np.ascontiguousarray(w["u"].reshape(m, 3, m).transpose(1, 2, 0))
        dh, through = np.zeros((len(rows), m), np.float32), np.empty((3, len(rows), m), np.float32)
        for n, b in zip(alive.tolist()[::-1], ends[::-1], strict=True):
            a = b - n
            d, g = dh[:n], by[:, a:b]
            g *= d
            d *= z[a:b]
            for x in np.matmul(g[:3], back, out=through[:, :n]):
                d += x
            d += dflat[a:b]
        grad["u"] += np.concatenate(np.matmul(states.T, by[:3]), axis=1)
        read += n_all
        # only the inputs that occur have a gradient
        order = np.argsort(flat.astype(np.int16), kind="stable")
        own = flat.take(order)
        starts = _starts(own)
        own = own[starts]
        g = np.add.reduceat(np.concatenate([by[i].take(order, axis=0) for i in (0, 1, 3)], axis=1), starts)
        g /= np.float32(n_all)
        seen = square["g"].take(own, axis=0)
        seen += g * g
        square["g"][own] = seen
        g /= np.sqrt(seen, out=seen)
        g *= rate
        w["g"][own] = w["g"].take(own, axis=0) - g
        for k, g in grad.items():
            g /= n_all
            square[k] += g * g
            g /= np.sqrt(square[k])
            g *= rate
            w[k] -= g


def score_batch(w: dict, ids: list[np.ndarray], classes: int) -> np.ndarray:
    """log P of each document, in nats, without shapes' own shares."""
    total = np.zeros(len(ids))
    order = np.array(sorted(range(len(ids)), key=lambda i: -len(ids[i])), np.int64)
    if not len(order):
        return total
    lens = np.array([len(ids[i]) for i in order])
    starts = np.concatenate([[0], np.cumsum(lens)[:-1]])
    flat = np.concatenate([ids[i] for i in order])
    longest = int(lens[0])
    alive = np.searchsorted(-lens, -np.arange(longest), side="left")
    h, t = np.zeros((len(order), HIDDEN), np.float32), 0
    u, hu = _recurrent(w), np.empty((3, len(order), HIDDEN), np.float32)
    while t < longest:
        first, left = t, OUTPUTS
        while t < longest and left > 0:
            left -= max(int(alive[t]), OUTPUTS // 4096)
            t += 1
        live = alive[first:t].tolist()
        owner = np.concatenate([np.arange(n) for n in live])
        x = flat[starts[owner] + np.repeat(np.arange(first, t), live)]
        inputs, states, b = _inputs(w, x), np.empty((len(x), HIDDEN), np.float32), 0
        for n in live:
            h = h[:n]
            states[b : b + n] = h
            _step(u, h, inputs[:, b : b + n], hu[:, :n], h)
            b += n
        lp = _outputs(w, states, x, classes)
        total[order] += np.bincount(owner, weights=lp, minlength=len(order))
    return total


class Reader:
    """Texts as input numbers."""

    def __init__(self, v: Vocabulary):
        self.v, self.head = v, pc.SetLookupOptions(pa.array(v.words, pa.large_binary()).cast(pa.large_string(), safe=False))
        at = [i for i, w in enumerate(v.words) if w == END]
        self.end = at[0] if at else -1
        self.end_number = v.number[self.end] if at else VOCABULARY + shape(END)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array]:
        """(numbers, places in the head or -1, tokens a text) with the ends, and (text, word) of the words that the head lacks, with the words."""
        words, n = tokens(texts)
        found = np.asarray(pc.index_in(words, options=self.head).fill_null(-1), np.int64)
        x = self.v.number[found]
        rare = np.flatnonzero(found < 0)
        other = words.take(pa.array(rare)).dictionary_encode()
        code, names = np.asarray(other.indices, np.int64), other.dictionary
        if len(rare):
            x[rare] = (VOCABULARY + shapes(names))[code]
        owner = np.repeat(np.arange(len(n)), n)
        place, ends = np.arange(len(x)) + owner, np.cumsum(n + 1) - 1
        out, where = np.full(len(x) + len(n), self.end_number, np.int32), np.full(len(x) + len(n), self.end, np.int64)
        out[place], where[place] = x, found
        return out, where, n + 1, owner[rare], code, names

    def segments(self, batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for big in batches:
            for at in range(0, big.num_rows, ROWS):
                x, _, n, *_ = self(big.column(0).slice(at, ROWS))
                for t in np.split(x, np.cumsum(n)[:-1]):
                    yield from (t[a : a + SEGMENT] for a in range(0, len(t), SEGMENT))


def _bytes(w: dict[str, np.ndarray]) -> bytes:
    return b"".join(w[k].astype(np.float32).tobytes() for k in sorted(w))


def _weights(raw: bytes, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    flat, at, out = np.frombuffer(raw, np.float32), 0, {}
    for k in sorted(like):
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape).copy()
        at += like[k].size
    return out


def averaged(copies: DataFrame) -> bytes:
    """The mean of the copies by tokens read: FAN of them at a time, in the order of their numbers. b"" without any.

    copies: trainer, block, read, w: stored; a copy is cut into blocks.
    """

    def mean(t: pa.Table) -> pa.Table:
        t = t.sort_by("trainer")
        n = np.asarray(t["read"], np.float64)
        x = np.stack([np.frombuffer(b, np.float32) for b in t["w"].to_pylist()])
        return pa.table({"trainer": t["group"][:1], "block": t["block"][:1], "read": pa.array([n.sum()]), "w": pa.array([((n / n.sum()) @ x).astype(np.float32).tobytes()], pa.binary())})

    while True:
        last = copies.agg(F.max("trainer")).first()[0]
        if not last:
            break
        grouped = copies.withColumn("group", F.floor(F.col("trainer") / FAN).cast("int")).groupBy("group", "block")
        copies = stored(grouped.applyInArrow(mean, "trainer int, block int, read double, w binary"))
    return b"".join(bytes(r["w"]) for r in copies.orderBy("block").select("w").collect())


def fit(docs: DataFrame, v: Vocabulary, held_out: int = 1, rounds: int = ROUNDS) -> dict[str, np.ndarray]:
    """Rounds of local training, on other training rows each and together on all, and of averaging by tokens read.

    Each task trains on the rows that it reads, in their order; texts are not moved.
    """
    spark = docs.sparkSession
    w, block = start_weights(v), 1 << 14
    vocab = spark.sparkContext.broadcast(v)
    text = docs.where(fold_column() != held_out).select("doc_id", "text").where("text is not null")
    for k in range(rounds):
        part = text.where(F.pmod(F.xxhash64("doc_id", "text", F.lit(7)), F.lit(rounds)) == k).select("text")
        now = spark.sparkContext.broadcast(w)

        def run(batches: Iterator[pa.RecordBatch], now=now, rate=0.1 / (1 + k)) -> Iterator[pa.RecordBatch]:
            own = {n: x.copy() for n, x in now.value.items()}
            read = train(own, Reader(vocab.value).segments(batches), vocab.value.classes, rate)
            raw, me = np.frombuffer(_bytes(own), np.float32), TaskContext.get().partitionId()
            if read:
                cut = range(0, len(raw), block)
                yield pa.RecordBatch.from_arrays([pa.array([me] * len(cut), pa.int32()), pa.array([a // block for a in cut], pa.int32()), pa.array([float(read)] * len(cut)), pa.array([raw[a : a + block].tobytes() for a in cut], pa.binary())], names=["trainer", "block", "read", "w"])

        got = averaged(stored(part.mapInArrow(run, "trainer int, block int, read double, w binary")))
        if got:
            w = _weights(got, w)
    return w


def score(docs: DataFrame, counts: DataFrame, v: Vocabulary, w: dict[str, np.ndarray], held_out: int = 1) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row for each row of docs.

    A null text is an empty one, the end alone. Repeated rows are scored each. With no training
    documents every word counts 0 and has the same probability in its class.
    """
    spark = docs.sparkSession
    vocab, weights = spark.sparkContext.broadcast(v), spark.sparkContext.broadcast(w)
    columns = ["doc_id", "row", "n_tokens", "n_known", "head", "score", "rare"]
    rare_type = pa.list_(pa.struct([("word", pa.binary()), ("k", pa.int64())]))
    log_e = float(np.log10(np.e))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocab.value
        mass = np.log10(v.shape_mass)
        base = np.log10(v.count + 0.5)
        more = np.where(v.number >= VOCABULARY, base - mass[np.maximum(v.number - VOCABULARY, 0)], 0.0)
        read = Reader(v)
        for big in batches:
            for at in range(0, big.num_rows, ROWS):
                b = big.slice(at, ROWS)
                x, found, n, text, code, names = read(b.column("text"))
                owner, hit = np.repeat(np.arange(len(n)), n), found >= 0
                total = lambda w, owner=owner, n=n: np.bincount(owner, weights=w, minlength=len(n))
                head, seen = total(np.where(hit, base[found], 0.0)), total(hit & (v.count[found] > 0))
                own = total(np.where(hit, more[found], -mass[np.maximum(x - VOCABULARY, 0)]))
                pair, k = np.unique(text * max(1, len(names)) + code, return_counts=True)
                if read.end < 0:  # no training document, so no end among the words
                    head = head + np.log10(0.5)
                ends = np.cumsum(np.bincount(pair // max(1, len(names)), minlength=len(n)))
                pairs = pa.StructArray.from_arrays([names.take(pa.array(pair % max(1, len(names)))).cast(pa.binary()), pa.array(k, pa.int64())], fields=list(rare_type.value_type))
                rare = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pairs)
                lm = score_batch(weights.value, np.split(x, np.cumsum(n)[:-1]), v.classes) * log_e + own
                if read.end < 0:
                    lm = lm + np.log10(0.5)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("row"), pa.array(n, pa.int64()), pa.array(seen.astype(np.int64)), pa.array(head), pa.array(lm), rare], names=columns)

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row"))
    part = stored(rows.mapInArrow(run, f"doc_id {kind}, row long, n_tokens long, n_known long, head double, score double, rare array<struct<word:binary,k:bigint>>"))
    rare = part.select("row", F.explode("rare").alias("x")).select("row", "x.word", "x.k").join(counts.select("word", "c"), "word", "left")
    c = F.coalesce("c", F.lit(0))
    sums = rare.groupBy("row").agg(F.sum(F.when(c > 0, F.col("k")).otherwise(0)).alias("more_known"), F.sum(F.col("k") * F.log10(c + 0.5)).alias("tail"))
    norm = float(np.log10(v.total + 0.5 * (v.distinct + 1)))
    tail = F.coalesce("tail", F.lit(0.0))
    return part.drop("rare").join(sums, "row", "left").select(
        "doc_id",
        (fold_column() == held_out).alias("held_out"),
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(v.total).cast("long").alias("train_tokens"),
        (F.col("head") + tail - F.col("n_tokens") * F.lit(norm)).alias("base_score"),
        (F.col("score") + tail).alias("score"),
    )


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counts = counted(docs)
    v = vocabulary(counts)
    return score(docs, counts, v, fit(docs, v))
