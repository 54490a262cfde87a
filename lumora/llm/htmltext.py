"""HTML extraction: the maximum-scoring run of a page, where words score positive and tags negative.

The weights come from labelled pages: pages with one <article> or <main> label their own words and
tags as inside or outside of the content. A tag that stands mostly outside costs more. A mark (a class or id
word, a role, an element such as nav) that stands mostly around words outside makes its element one
that holds no content; its words count against a run and are left out of the text. Marks with a
telling name start from a prior count of outside words, which what pages show may outweigh. On
pages with content elements, words outside of these count against a run, and tags inside cost least. A linear scan
finds the best contiguous run; the blocks inside it, without such elements, are the text.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumora.llm.common import map_batches, sample_of_rows, table

#: Pages that the weights are learned from, and tags and marks that are learned, at most.
TRAIN_ROWS, KEYS = 2000, 50_000
WORD_WEIGHT, OUTSIDE_WORD, OUTSIDE_TAG, UNSEEN_TAG, LEAST_TAG = 1.0, -0.5, -1.0, -1.0, -0.05
#: Words outside that a mark with a telling name starts from; words of both kinds that every mark starts from.
PRIOR, SMOOTH = 200.0, 20.0

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)(?:>|\Z)|<[!?][^>]*(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z_:-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_RAW = frozenset("script style textarea noscript template iframe svg title xmp noembed noframes".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
_CONTENT = frozenset(("article", "main"))
_NEVER = frozenset("nav aside form button select dialog object canvas audio video head footer menu fieldset datalist".split())
_NEVER_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
_NEVER_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert newsletter subscribe subscription signup popup modal overlay "
    "menu nav navbar navigation breadcrumb breadcrumbs sidebar widget widgets related recommended share sharing social comment comments commentlist disqus respond reply replies footer masthead topbar toolbar login search pagination pager skip".split()
)
_COMMENTS = frozenset(("comment", "comments", "reply"))
_SPLIT = re.compile(r"[^a-z]+")


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(text)}


def marks(name: str, attributes: str, inside: bool) -> list[str]:
    """What an element shows of whether it holds content; inside: whether it stands in an <article> or <main>."""
    a = _attributes(attributes) if attributes.strip() else {}
    if name in _CONTENT or name in ("html", "body"):
        # comments are sometimes articles of their own
        return [f".{x}" for x in _SPLIT.split(a.get("class", "").lower()) if x in _COMMENTS] if name == "article" and inside else []
    out = [f"<{name}>"] if name in _NEVER or (name == "header" and not inside) else []
    if "hidden" in a or a.get("aria-hidden", "").lower() == "true" or "display:none" in a.get("style", "").lower().replace(" ", ""):
        out.append("hidden")
    if role := a.get("role", "").lower()[:40]:
        out.append(f"role={role}")
    names = {x[:40] for x in _SPLIT.split(f"{a.get('class', '')} {a.get('id', '')}".lower()) if x}
    return out + sorted(f".{x}" for x in names if x != "header" or not inside)


def telling(mark: str) -> bool:
    """Whether a mark's name tells of an element without content."""
    return mark[0] == "<" or mark in ("hidden", ".header") or mark.removeprefix("role=") in _NEVER_ROLES or mark[1:] in _NEVER_NAMES


class Model(NamedTuple):
    tags: dict[str, float]
    marks: dict[str, float]  # log odds of content

    def never(self, name: str, attributes: str, inside: bool) -> bool:
        """Whether an element holds no content: by the mark that speaks most against it."""
        return any(self.marks.get(m, -1.0 if telling(m) else 0.0) < 0 for m in marks(name, attributes, inside))


#: Before anything was learned.
PLAIN = Model({}, {})


def tokens(page: str, model: Model = PLAIN) -> list[tuple]:
    """("text", text, never, inside), or ("tag", key, block, never, inside, content): content is 1 where <article> or <main> opens, -1 where it closes.

    Raw elements (scripts, styles, ...) and comments leave no token; never: within an element that holds
    no article; inside: the depth of <article> and <main>.
    """
    out, at, inside = [], 0, 0
    closing, depth, since = "", 0, 0  # the never-element that we are in, its depth, and `inside` where it began
    while at < len(page):
        m = _TOKEN.search(page, at)
        stop = m.start() if m else len(page)
        if stop > at:
            out.append(("text", page[at:stop], bool(closing), inside))
        if not m:
            break
        at = m.end() if m.end() > m.start() else m.start() + 1
        if not m[2]:
            continue
        end, name, attributes = bool(m[1]), m[2].lower(), m[3]
        if name in _RAW:
            if not end and not attributes.endswith("/"):
                close = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
                at = close.end() if close else len(page)
            continue
        void = name in _VOID or attributes.endswith("/")
        content = 0
        if closing and name in _CONTENT and not end and inside == 0 and not model.never(name, attributes, True):
            closing, depth = "", 0  # an article in it: a wrapper, or never closed
        if closing and end and name in _CONTENT and inside <= since and name != closing:
            closing, depth = "", 0  # the article around it ends
        if closing:
            if name == closing and not void:
                depth += -1 if end else 1
            if depth == 0:
                closing = ""
                out.append(("tag", f"/{name}", name in _BLOCK, True, inside, 0))
                continue
        elif not end and not void and model.never(name, attributes, inside > 0):
            closing, depth, since = name, 1, inside
        if name in _CONTENT and not closing:
            content = -1 if end else 1
            inside = max(0, inside + content)
        first = _SPLIT.split(_attributes(attributes).get("class", "").lower())[0] if attributes.strip() and not end else ""
        key = ("/" if end else "") + name + (f".{first}" if first else "")
        out.append(("tag", key, name in _BLOCK, bool(closing), inside, content))
    return out


def elements(page: str) -> tuple[int, list[tuple[list[str], int, int]]]:
    """The words inside of <article> and <main>, and for each element with marks these and its words inside and outside.

    What stands in an element with a telling name is counted for it and those around it, not for those that it holds.
    """
    out, at, inside, total, held = [], 0, 0, 0, 0
    stack: list[tuple[str, list[str], bool, list[int]]] = []
    told = 0  # elements with telling names that are open

    def close() -> None:
        nonlocal told
        _, ms, speaks, n = stack.pop()
        told -= speaks
        if ms:
            out.append((ms, n[0], n[1]))

    while at < len(page):
        m = _TOKEN.search(page, at)
        stop = m.start() if m else len(page)
        if n := len(page[at:stop].split()):
            total += n * (inside > 0)
            for _, _, speaks, count in stack:
                count[inside == 0] += n
                if speaks:
                    break
        if not m:
            break
        at = m.end() if m.end() > m.start() else m.start() + 1
        if not m[2]:
            continue
        end, name, attributes = bool(m[1]), m[2].lower(), m[3]
        if name in _RAW:
            if not end and not attributes.endswith("/"):
                raw = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
                at = raw.end() if raw else len(page)
            continue
        if name in _CONTENT and not told:
            inside = max(0, inside + (-1 if end else 1))
        if end:
            if any(x[0] == name for x in stack):
                while stack[-1][0] != name:
                    close()
                close()
        elif name not in _VOID and not attributes.endswith("/"):
            ms = marks(name, attributes, inside > 0)
            if ms or name in _BLOCK:
                speaks = any(map(telling, ms))
                told += speaks
                stack.append((name, ms, speaks, [0, 0]))
    while stack:
        close()
    return total, out


def counted(page: str) -> tuple[Counter, Counter] | None:
    """Of a labelled page: counts of (tag, inside), and words by (mark, inside); None for other pages.

    An element with a telling name in the content counts as outside of it, unless it holds most of the content's words.
    """
    ts = tokens(page)
    if sum(t[0] == "tag" and t[5] == 1 for t in ts) != 1:
        return None
    tags = Counter((t[1], t[4] > 0 or t[5] != 0) for t in ts if t[0] == "tag" and not t[3])
    words: Counter = Counter()
    total, found = elements(page)
    for ms, n_in, n_out in found:
        for m in ms:
            part = telling(m) and 2 * n_in <= total
            words[m, True] += 0 if part else n_in
            words[m, False] += n_out + n_in if part else n_out
    return tags, words


def weights_of(tags: Counter, words: Counter) -> Model:
    """A weight below 0 for each tag: the log odds of standing outside, at least LEAST_TAG; log odds of content for each mark."""
    out = {}
    for key in {k for k, _ in tags}:
        inside, outside = tags[key, True], tags[key, False]
        out[key] = -min(40.0, max(-LEAST_TAG, 3 * (math.log((outside + 0.5) / (inside + 0.5)) + 1)))
    return Model(out, {m: math.log((words[m, True] + SMOOTH) / (words[m, False] + SMOOTH + PRIOR * telling(m))) for m, _ in words})


def best_run(scores: list[float]) -> tuple[int, int]:
    """Bounds of the contiguous run with the largest sum; the first of equals; (0, 0) if no sum is above 0."""
    best, run, start, bounds = 0.0, 0.0, 0, (0, 0)
    for i, x in enumerate(scores):
        if run <= 0:
            run, start = 0.0, i
        run += x
        if run > best:
            best, bounds = run, (start, i + 1)
    return bounds


def extract(page: str, model: Model) -> str:
    """Blocks of the best run, one a line; "" for a page without any.

    Content elements count as such when they hold at least half of the words outside of elements without content.
    """
    ts = tokens(page, model)
    size = [len(t[1].split()) if t[0] == "text" else 0 for t in ts]
    words = sum(n for n, t in zip(size, ts, strict=True) if t[0] == "text" and not t[2])
    marked = sum(n for n, t in zip(size, ts, strict=True) if t[0] == "text" and not t[2] and t[3] > 0)
    framed = marked > 0 and 2 * marked >= words
    scores = []
    for n, t in zip(size, ts, strict=True):
        if t[0] == "text":
            never, inside = t[2], framed and t[3] > 0
            scores.append(n * ((0.0 if inside else OUTSIDE_WORD) if never else WORD_WEIGHT if inside or not framed else OUTSIDE_WORD))
        else:
            never, inside = t[3], framed and (t[4] > 0 or t[5] != 0)
            scores.append((0.0 if inside else OUTSIDE_TAG) if never else LEAST_TAG if inside else model.tags.get(t[1], UNSEEN_TAG))
    a, b = best_run(scores)
    blocks, current = [], []
    for t in ts[a:b]:
        if t[0] == "text":
            if not t[2]:
                current.append(html.unescape(t[1]))
        elif t[2]:
            blocks.append("".join(current))
            current = []
        elif t[1] in ("br", "/br"):
            current.append(" ")
    blocks.append("".join(current))
    return "\n".join(x for x in (" ".join(s.split()) for s in blocks) if x)


def fit(pages: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Weights from at most `rows` pages of any length, those of the smallest hashes. Counts come to the driver, of the KEYS most frequent tags and marks."""
    sample = sample_of_rows(pages.select("page_id", "url", "html"), rows, "page_id", "url", "html")

    def count(b: pa.RecordBatch) -> pa.RecordBatch:
        total: Counter = Counter()
        for page in b.column("html").to_pylist():
            for kind, c in enumerate(counted(page or "") or ()):
                for (key, inside), n in c.items():
                    total[kind, key[:80], inside] += n
        keys = sorted(total)
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.string()), pa.array([k[2] for k in keys], pa.bool_()), pa.array([total[k] for k in keys], pa.int64())], names=["kind", "key", "inside", "n"])

    sums = map_batches(sample, count, "kind int, key string, inside boolean, n long").groupBy("kind", "key", "inside").agg(F.sum("n").alias("n"))
    got = sums.orderBy(F.desc("n"), "kind", "key", "inside").limit(KEYS).collect()
    tags, words = (Counter({(r["key"], r["inside"]): r["n"] for r in got if r["kind"] == k}) for k in (0, 1))
    return weights_of(tags, words)


def main_text(pages: DataFrame, model: Model) -> DataFrame:
    """page_id, url, text, n_chars: one row for each row of pages.

    A null page counts as empty; its text is "". Repeated rows are extracted each; pages of any length are read
    whole; an empty table gives no rows; other columns of pages are ignored. Of equal runs the first one counts.
    """
    types = {f.name: f.dataType.simpleString() for f in pages.schema.fields}

    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        text = [extract(p or "", model) for p in b.column("html").to_pylist()]
        return pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(text, pa.string()), pa.array(map(len, text), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return map_batches(pages.select("page_id", "url", "html"), one, f"page_id {types['page_id']}, url {types['url']}, text string, n_chars long")


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return main_text(pages, fit(pages))
