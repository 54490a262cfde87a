"""Personal data: patterns, and a skip-chain conditional random field over number- and mail-like tokens.

The nodes of a document's graph are its tokens with a digit or an @; other tokens carry no such data
and are only context. Neighbouring nodes are linked as in a chain; nodes of the same text, or of the
same digits, share a skip potential wherever they stand. Loopy sum-product message
passing makes labels agree across the document, so that a repeated number that a pattern found in one
place is found in the others. The field learns from the patterns' own spans on a bounded sample.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumora.llm.common import map_batches, sample_of_rows, table

KINDS = ("email", "ip", "card", "phone")
#: Documents that the field is fitted on, at most; their texts, of any length, are cut into pieces of about so many
#: characters, of which so many at most come to the driver.
TRAIN_ROWS, PIECE, PIECES = 4000, 4096, 8000
#: Messages are passed until none changes by more than this, in so many rounds at most.
STILL, ROUNDS = 1e-3, 200
#: Largest link potential, and what equal labels of one group have before anything is learned.
MOST, ALIKE = 6.0, 3.0
#: Least probability of a label that adds a span.
SURE = 0.6
#: The last so many features of a node describe its neighbourhood.
CONTEXT = 3

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A digit in front can't change a match: what fails at the first digit of a run fails at its others.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NUMBER = re.compile(r"[0-9]+")
_SPACE = re.compile(r"[\x20\x09-\x0D]")
_NODE = re.compile(r"[^\x20\x09-\x0D]*[0-9@][^\x20\x09-\x0D]*")
_EDGES = ".,;:!?\"'<>[]{}"


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches; each @ is looked at once, with the run of local characters before it."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        done = m.end() if m else at + 1
        if m:
            out.append((start, m.end()))
        at = text.find("@", done)
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns' spans, in order."""
    out = [(s, 0, e) for s, e in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split("."))]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and _luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= sum(map(len, _NUMBER.findall(m[0]))) <= 15]
    return sorted(out)


def _shape(token: str) -> str:
    s = re.sub(r"[0-9]+", lambda m: str(min(len(m[0]), 20)), token[:200])
    return re.sub(r"[^\W\d_]+", "a", s)[:40]


def _sound(token: str, digits: str) -> str:
    """Whether a long number passes Luhn, or a dotted one has parts of at most 255."""
    if 12 <= len(digits) <= 19 and len(digits) == len(token):
        return "card" if _luhn(digits) else "no card"
    if token.count(".") == 3:
        parts = token.split(".")
        if all(p.isdecimal() and len(p) < 9 for p in parts):
            return "ip" if all(int(p) <= 255 for p in parts) else "no ip"
    return "-"


class Node(NamedTuple):
    start: int
    end: int
    group: str
    features: tuple[str, ...]


def nodes(text: str) -> list[Node]:
    """Tokens with a digit or @, without punctuation around them."""
    found = []
    for m in _NODE.finditer(text):
        raw = m[0]
        left = len(raw) - len(raw.lstrip(_EDGES))
        token = raw.strip(_EDGES)
        if token and re.search(r"[0-9@]", token):
            found.append((m.start() + left, token))
    out = []
    for i, (start, token) in enumerate(found):
        digits = "".join(_NUMBER.findall(token))
        before = text[max(0, start - 40) : start].split(" ")[-2:-1] or [""]
        near = lambda k: _shape(found[k][1]) if 0 <= k < len(found) and abs(found[k][0] - start) < 40 else "-"  # noqa: B023,E731
        letters = sum(c.isalpha() for c in token)
        features = (
            "bias",
            f"shape={_shape(token)}",
            f"form={re.sub('[0-9]+', '9', _shape(token))}",
            f"digits={min(len(digits), 20)}",
            f"letters={min(letters, 3)}",
            f"at={'@' in token},plus={token[:1] == '+'}",
            f"dots={min(token.count('.'), 4)}",
            f"sound={_sound(token, digits)}",
            f"before={before[0][-12:].lower()}" if before[0] and not re.search("[0-9]", before[0]) and len(before[0]) < 9 else "before=",
            f"left={near(i - 1)}",
            f"right={near(i + 1)}",
        )
        # a node is like another when its digits are the same (7 or more), or else its whole text
        out.append(Node(start, start + len(token), digits if len(digits) >= 7 and not letters else token.lower(), features))
    return out


def links(ns: list[Node]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Chain links between neighbours, and skip links between successive nodes of one group."""
    chain = [(i, i + 1) for i in range(len(ns) - 1) if ns[i + 1].start - ns[i].end <= 2]
    last: dict[str, int] = {}
    skip = []
    for i, n in enumerate(ns):
        j = last.get(n.group)
        if j is not None and j + 1 != i:
            skip.append((j, i))
        elif j is not None and (j, i) not in chain[-1:]:
            skip.append((j, i))
        last[n.group] = i
    return chain, skip


class Model(NamedTuple):
    weights: dict[str, np.ndarray]  # 5 numbers a feature: none, then KINDS
    chain: np.ndarray
    skip: np.ndarray


def labels_of(text: str, ns: list[Node]) -> list[int]:
    """0, or 1 + the kind of the first pattern span that overlaps the node."""
    spans = base_spans(text)
    return [next((1 + k for s, k, e in spans if s < n.end and e > n.start), 0) for n in ns]


def fit_texts(texts: list[str], steps: int = 300) -> Model:
    """Node weights and link potentials together, by pseudo-likelihood: each node's label given its features and its neighbours' labels.

    Labels are those of the patterns. A node that they miss, of a group in which they found another, takes that one's
    label: so links learn what features can't tell.
    """
    index: dict[str, int] = {}
    rows: Counter[tuple] = Counter()
    for t in texts:
        ns = nodes(t)
        ys = labels_of(t, ns)
        of_group = {n.group: y for n, y in zip(ns, ys, strict=True) if y}
        ys = [y or of_group.get(n.group, 0) for n, y in zip(ns, ys, strict=True)]
        left, right, near = [0] * len(ns), [0] * len(ns), [[0] * 5 for _ in ns]
        chain, skip = links(ns)
        for i, j in chain:  # 0 stands for no neighbour
            right[i], left[j] = 1 + ys[j], 1 + ys[i]
        for i, j in skip:
            near[i][ys[j]] += 1
            near[j][ys[i]] += 1
        for i, (n, y) in enumerate(zip(ns, ys, strict=True)):
            f = tuple(index.setdefault(f, len(index)) for f in n.features)
            unseen = f[:-CONTEXT] + (index.setdefault("-", len(index)),) * CONTEXT  # as if the context were new
            for shown in (f, unseen):
                rows[shown, left[i], right[i], tuple(near[i]), y] += 0.5
    w, chain_, skip_ = np.zeros((max(1, len(index)), 5)), np.zeros((6, 6)), ALIKE * np.eye(5)
    if rows:
        x, at_left, at_right, beside, y = (np.array(v) for v in zip(*rows, strict=True))
        c = np.array(list(rows.values()), float) / sum(rows.values())
        one = np.eye(5)[y]
        squares = [np.full(v.shape, 1e-8) for v in (w, chain_, skip_)]
        for _ in range(steps):
            s = w[x].sum(axis=1) + chain_[at_left, 1:] + chain_.T[at_right, 1:] + beside @ skip_
            p = np.exp(s - s.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            g = (one - p) * c[:, None]
            by_node = np.stack([np.bincount(x.ravel(), weights=np.repeat(g[:, k], x.shape[1]), minlength=len(w)) for k in range(5)], axis=1) - 1e-4 * w
            by_chain = np.zeros((6, 6))
            for k in range(5):
                by_chain[:, 1 + k] += np.bincount(at_left, weights=g[:, k], minlength=6)
                by_chain[1 + k] += np.bincount(at_right, weights=g[:, k], minlength=6)
            by_skip = beside.T @ g
            for v, grad, square in zip((w, chain_, skip_), (by_node, by_chain - 1e-4 * chain_, by_skip + by_skip.T - 1e-4 * (skip_ - ALIKE * np.eye(5))), squares, strict=True):
                square += grad * grad
                v += 0.5 * grad / np.sqrt(square)
            chain_[0] = chain_[:, 0] = 0
    return Model({f: w[i] for f, i in index.items()}, chain_[1:, 1:].clip(-MOST, MOST), skip_.clip(-MOST, MOST))


def beliefs(ns: list[Node], model: Model) -> np.ndarray:
    """[nodes, 5] probabilities by loopy sum-product message passing, damped, until it stands still.

    Skip links go from each node to the next of its group: n nodes have n - 1 links, and messages go along all of them.
    """
    zero = np.zeros(5)
    node = np.array([sum((model.weights.get(f, zero) for f in n.features), zero) for n in ns]).reshape(-1, 5)
    chain, skip = links(ns)
    edges = [(i, j, 0) for i, j in chain] + [(i, j, 1) for i, j in skip]
    if edges:
        pots = (np.exp(model.chain), np.exp(model.skip))
        source = np.array([e for i, j, _ in edges for e in (i, j)])
        target = np.array([e for i, j, _ in edges for e in (j, i)])
        pot = np.array([p for _, _, k in edges for p in (pots[k], pots[k].T)])
        back = np.arange(len(source)) ^ 1
        message = np.zeros((len(source), 5))
        for _ in range(ROUNDS):
            total = node.copy()
            np.add.at(total, target, message)
            cavity = total[source] - message[back]
            cavity = np.exp(cavity - cavity.max(axis=1, keepdims=True))
            new = np.log(np.einsum("ea,eab->eb", cavity, pot))
            new -= new.max(axis=1, keepdims=True)
            change = np.abs(new - message).max()
            message = 0.5 * message + 0.5 * new
            if change < STILL:
                break
        np.add.at(node, target, message)
    p = np.exp(node - node.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def find(text: str, model: Model, sure: float = SURE) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """The patterns' spans, and all spans: those and the field's that overlap none of them. (start, kind, end)."""
    base = base_spans(text)
    ns = nodes(text) if "@" in text or _DIGIT.search(text) else []
    if not ns:
        return base, base
    p = beliefs(ns, model)
    extra, last, at = [], None, 0
    for i, k in enumerate(p.argmax(axis=1)):
        if not k or p[i, k] < sure:
            last = None
            continue
        n = ns[i]
        while at < len(base) and base[at][2] <= n.start:
            at += 1
        if any(s < n.end and e > n.start for s, _, e in base[max(0, at - 3) : at + 4]):
            last = None
            continue
        if last == k and n.start - extra[-1][2] <= 2:
            extra[-1] = (extra[-1][0], k - 1, n.end)  # neighbours of one kind are one span
        else:
            extra.append((n.start, int(k) - 1, n.end))
        last = k
    return base, sorted(base + extra)


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def pieces(text: str) -> Iterator[str]:
    """The parts of a text with a digit or @, cut at white space where PIECE characters are full."""
    at = 0
    while at < len(text):
        end = at + PIECE
        cut = _SPACE.search(text, end) if end < len(text) else None
        end = cut.start() if cut else len(text)
        if _DIGIT.search(text, at, end) or text.find("@", at, end) >= 0:
            yield text[at:end]
        at = end


def fit(docs: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Fits the field on at most `rows` documents with a digit or @, those of the smallest hashes, in at most PIECES pieces."""
    known = docs.select("doc_id", "text").where(F.col("text").rlike("[0-9@]"))

    def cut(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([p for t in b.column("text").to_pylist() for p in pieces(t)], pa.string())], names=["text"])

    every = map_batches(sample_of_rows(known, rows, "doc_id", "text").select("text"), cut, "text string")
    return fit_texts(sorted(r["text"] for r in every.orderBy(F.xxhash64("text"), "text").limit(PIECES).collect()))


def find_all(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (pattern spans), base_sha256, spans: one row for each row of docs.

    A null text counts as empty: no spans, and the digest of the empty text. Repeated rows are searched each, texts of
    any length whole; an empty table gives no rows; other columns are ignored. Where the field and a pattern overlap the pattern stays.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        counts, digests, spans = [], [], []
        for t in b.column("text").to_pylist():
            base, every = find(t or "", shared.value)
            n = Counter(k for _, k, _ in base)
            counts.append([n[k] for k in range(4)])
            digests.append(hashlib.sha256(written(base).encode()).hexdigest())
            spans.append(written(every))
        numbers = [pa.array([c[k] for c in counts], pa.int64()) for k in range(4)]
        return pa.RecordBatch.from_arrays([b.column("doc_id"), *numbers, pa.array(digests), pa.array(spans)], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs.select("doc_id", "text"), one, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return find_all(docs, fit(docs))
