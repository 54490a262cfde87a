"""Models and kernels without Spark, against brute force."""

import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lumora.llm import crf, htmltext, lm, neardup, packing, pii, quality, topk, toxicity


def test_chain_marginals_and_viterbi_against_enumeration():
    rng = np.random.default_rng(0)
    a = rng.normal(size=(2, 2))
    lengths = np.array([3, 1, 6, 2])
    u = rng.normal(size=lengths.sum()) * 2
    got, at = crf.marginals(u, lengths, a), 0
    for n in lengths:
        own = u[at : at + n]
        score = {y: sum(v * x for v, x in zip(y, own, strict=True)) + sum(a[p, q] for p, q in itertools.pairwise(y)) for y in itertools.product((0, 1), repeat=int(n))}
        z = sum(math.exp(s) for s in score.values())
        want = [sum(math.exp(s) for y, s in score.items() if y[t]) / z for t in range(n)]
        assert np.allclose(got[at : at + n], want)
        assert tuple(crf.viterbi(own, a)) == max(score, key=score.get)
        at += n
    assert crf.viterbi([], a) == [] and len(crf.marginals(np.empty(0), np.empty(0, int), a)) == 0


def test_chain_training_learns_labels():
    rng = np.random.default_rng(1)
    y = (rng.random(600) < 0.3).astype(int)
    x = np.where(rng.random(600) < 0.95, y, 1 - y)[:, None] + 1
    w, a = crf.train(x, y, np.full(60, 10), 3)
    assert w[2] > 0 > w[1] and ((crf.marginals(w[x[:, 0]], np.full(60, 10), a) >= 0.5) == y).mean() > 0.9


def test_chain_gradient_against_enumeration():
    """Node and transition gradients are the numeric derivatives of the enumerated log likelihood."""
    rng = np.random.default_rng(2)
    lengths, a = np.array([4, 1, 3]), rng.normal(size=(2, 2))
    u, y = rng.normal(size=8), rng.integers(0, 2, 8).astype(float)
    weight = np.repeat([2.0, 1.0, 0.5], lengths)

    def likelihood(u, a):
        total, at = 0.0, 0
        for n in lengths:
            own, real = u[at : at + n], tuple(y[at : at + n].astype(int))
            score = {z: sum(v * x for v, x in zip(z, own, strict=True)) + sum(a[p, q] for p, q in itertools.pairwise(z)) for z in itertools.product((0, 1), repeat=int(n))}
            total += weight[at] * (score[real] - math.log(sum(math.exp(s) for s in score.values())))
            at += n
        return total

    nodes, pairs = crf.gradient(u, y, lengths, a, weight)
    step = 1e-5
    for i in range(8):
        d = np.eye(8)[i] * step
        assert abs((likelihood(u + d, a) - likelihood(u - d, a)) / (2 * step) - nodes[i]) < 1e-6
    for i, j in itertools.product((0, 1), repeat=2):
        d = np.zeros((2, 2))
        d[i, j] = step
        assert abs((likelihood(u, a + d) - likelihood(u, a - d)) / (2 * step) - pairs[i, j]) < 1e-6


def brute_repeats(words):
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    hit = set()
    for i, w in enumerate(windows):
        if windows.count(w) > 1:
            hit |= {i, i + 1, i + 2}
    return len(hit)


def test_quality_base_rules_against_brute_force():
    rng = random.Random(3)
    for _ in range(300):
        text = "".join(rng.choice(["a", "b", "é", " ", " ", "\n", "\t", "\x0b", "#", "|", "c d e "]) for _ in range(rng.randint(0, 60)))
        base, codes, sizes = quality.measure(text.encode())
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        lines = text.split("\n")
        dups = sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) and x in lines[:i] for i, x in enumerate(lines))
        assert base == (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dups, brute_repeats(words))
        assert len(codes) == len(sizes) and sum(sizes) == len(words)


def test_boilerplate_lines_inside_good_documents_are_marked():
    """Lines of symbols as in bad documents, and a line that unlike documents share, stand out in documents that stay."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8)))
    line = lambda n: (" ".join(word() for _ in range(n)).capitalize() + ".").encode()
    junk = lambda n: " | ".join(word() for _ in range(n)).encode()
    notice = b"This text may be copied under the terms of a licence."
    docs = []
    for i in range(400):
        good = i % 4 > 0
        lines = [line(rng.randint(5, 25)) if good else junk(rng.randint(5, 25)) for _ in range(rng.randint(3, 12))]
        if good and i % 3 == 0:
            lines.insert(rng.randrange(len(lines) + 1), notice if i % 2 else junk(12))
        docs.append((b"\n".join(lines), int(good)))
    one = [line(12) for _ in range(6)]  # a group of near copies is no boilerplate
    docs += [(b"\n".join([*one[:k], line(12), *one[k + 1 :]]), 1) for k in range(6) for _ in range(8)]
    chains = [(np.array(quality.measure(t)[1], np.int8), np.array([quality.line_hash(x) for x in t.split(b"\n")], np.uint64), y) for t, y in docs]
    m = quality.fit_chains(chains)
    assert quality.line_hash(notice) in m.repeated and not any(quality.line_hash(x) in m.repeated for x in one)

    def decoded(*lines):
        codes = quality.measure(b"\n".join(lines), m.repeated)[1]
        return crf.viterbi([float(m.weights[np.array(c) + quality._BASE].sum()) for c in codes], m.transitions)

    good = [line(15) for _ in range(8)]
    assert decoded(*good) == [1] * 8
    assert decoded(*good[:4], notice, *good[4:]) == [1] * 4 + [0] + [1] * 4
    assert decoded(*good[:4], junk(15), *good[4:]) == [1] * 4 + [0] + [1] * 4
    assert decoded(*(junk(15) for _ in range(5))) == [0] * 5
    none = quality.fit_chains([c for c in chains if c[2]])
    assert not none.weights.any() and not none.repeated


def test_toxicity_learns_parts_of_words():
    rng = random.Random(5)
    clean = lambda: [rng.choice("the of and thing over house water green stone light".split()) for _ in range(rng.randint(3, 40))]
    rows = []
    for i in range(400):
        words = clean()
        if i % 8 == 0:
            for _ in range(2):
                words.insert(rng.randrange(len(words) + 1), "vilo" + rng.choice(["ra", "mi", "tu", "se", "lo"]))
        rows.append((" ".join(words).encode(), int(i % 8 == 0)))
    m = toxicity.fit_rows(rows)
    texts = [b"the house vilolonew is green", b"the house is green", b"", b"VILORA!"]
    p, n = toxicity.Tagger(m).marginals(texts)
    s = crf.sigmoid(toxicity.summary(p, n) @ m.head)
    assert s[0] >= 0.5 > s[1] and s[2] < 0.5 <= s[3] and list(n) == [5, 4, 0, 1] and p[2] > 0.5 > p[0]
    only = toxicity.fit_rows([(b"a", 0), (b"b", 0)])
    assert (crf.sigmoid(toxicity.summary(*toxicity.Tagger(only).marginals(texts)) @ only.head) < 0.5).all()


def brute_spans(x):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", x)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", x) if all(int(v) <= 255 for v in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", x):
        d = re.sub("[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and pii._luhn(d):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", x) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def test_personal_data_patterns_against_brute_force():
    rng = random.Random(1)
    for _ in range(20_000):
        x = "".join(rng.choice("01259..@@a-+ ()%é") for _ in range(rng.randint(0, 40)))
        assert brute_spans(x) == pii.base_spans(x), x
    assert pii.base_spans("4111 1111 1111 1111 a@b.co 1.2.3.256 +1 (555) 123-4567") == [(0, 2, 19), (20, 0, 26), (37, 3, 54)]
    assert len(pii.emails("a" * 200_000 + "@" * 1000)) == 0


def test_skip_chains_carry_labels_over_a_document():
    rng = random.Random(2)
    card = lambda: next(d for d in iter(lambda: "".join(rng.choice("0123456789") for _ in range(16)), None) if pii._luhn(d))
    texts = [f"some words {card()} and more 3. text {rng.randint(1, 999)}" for _ in range(200)]
    model = pii.fit_texts(texts)
    assert model.skip.diagonal().min() > model.skip[0, 1:].max()
    number = card()
    ns = pii.nodes(f"here {number} there and again far away {number} end")
    assert pii.links(ns)[1] == [(0, 1)]
    p = pii.beliefs(ns, model)
    alone = pii.beliefs(ns[:1], model)
    assert p[:, 3].min() > 0.5 and p[0, 3] >= alone[0, 3]
    for text in ("", "no data here", f"x {number} y"):
        base, every = pii.find(text, model)
        assert set(base) <= set(every)
    assert pii.find("", pii.fit_texts([])) == ([], [])


def test_added_spans_held_out():
    """Numbers that a pattern finds in one place are found where they stand in another form; clean numbers stay."""
    rng = random.Random(14)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    number = lambda: "".join(rng.choice("0123456789") for _ in range(11))

    def document():
        d = number()
        return f"{text(20)} +{d} {text(30)} {rng.randint(1, 99)} {text(9)} {d} {text(12)} {d}. {text(4)}", d

    model = pii.fit_texts([document()[0] for _ in range(300)] + [f"{text(30)} {rng.randint(100, 99999)} {text(20)}" for _ in range(200)])
    hit = extra = 0
    for _ in range(100):
        t, d = document()
        base, every = pii.find(t, model)
        added = {t[a:b] for a, _, b in set(every) - set(base)}
        assert [t[a:b] for a, _, b in base] == ["+" + d]
        hit += sum(t[a:b] == d for a, _, b in set(every) - set(base))
        extra += len(added - {d})
        clean = f"{text(30)} {rng.randint(100, 99999)} {text(20)}"
        assert pii.find(clean, model) == ([], [])
    assert hit >= 190 and extra == 0
    # however many mentions there are, what the first one shows reaches the last
    d = number()
    _, every = pii.find(f"+{d} " + f"{text(6)} {d} " * 60, model)
    assert sum(e - s == 11 for s, _, e in every) == 60
    assert list(pii.pieces("x" * 5000 + " 1 " + "y" * 5000)) == [" 1 " + "y" * 5000] and "".join(pii.pieces("1 a " * 5000)) == "1 a " * 5000


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a="</p><article>";</script><style>p{}</style></head>
<body class="with-sidebar"><header><h1>Site</h1></header><nav><ul><li><a href="/">Home page</a></li></ul></nav>
<div id="cookie-notice">We use cookies</div><!-- <article>no</article> --><article><h1>A &amp; B</h1><p>One  <b>two</b>
three &lt;four&gt;.<p>Five six<br>seven</p><div class="ad">Buy now</div><ul><li>first</li><li>second</li></ul>
<form><input>Send</form><aside>Side</aside><section class="comments"><p>Nice post</p></section></article>
<aside>Long side bar text with many words in it to tempt the scan</aside><footer>&copy; me</footer></body></html>"""


def test_extraction():
    w = htmltext.weights_of(*htmltext.counted(PAGE))
    text = "A & B\nOne two three <four>.\nFive six seven\nfirst\nsecond"
    assert htmltext.extract(PAGE, w) == text
    assert htmltext.extract(PAGE.replace("</body></html>", ""), w) == text
    assert htmltext.extract("<div><p>No article, still words</p></div><nav>menu</nav>", w) == "No article, still words"
    # a heading and two articles in one content element are all of its content
    two = "<nav>menu words</nav><main><h1>The heading</h1><article><p>first " + "long " * 20 + "</p></article><article><p>second short one</p></article></main><p>outside</p>"
    assert htmltext.extract(two, w) == "The heading\nfirst " + "long " * 19 + "long\nsecond short one"
    # a card in a side bar is not the content
    card = "<div><p>" + "main words " * 30 + "</p></div><div class='card'><article><p>small card</p></article></div>"
    assert htmltext.extract(card, w).startswith("main words")
    for empty in ("", "<p></p>", "<script>x", "<!-- x", "<nav>a b</nav>"):
        assert htmltext.extract(empty, w) == ""
    assert htmltext.extract("a < b <", w) == "a < b <"
    rng = random.Random(4)
    for _ in range(200):
        x = [rng.choice([-2.0, -1.0, 1.0, 2.0]) for _ in range(rng.randint(0, 12))]
        a, b = htmltext.best_run(x)
        assert sum(x[a:b]) == max([0.0, *(sum(x[i:j]) for i in range(len(x)) for j in range(i + 1, len(x) + 1))])


def test_extraction_weights_are_learned():
    """What pages show outweighs telling names, and tells of names that nobody listed; nothing rests on <article>."""
    rng = random.Random(13)
    words = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))

    def page(i):
        content = "".join(f"<p>{words(rng.randint(3, 40))}</p>" for _ in range(rng.randint(2, 8)))
        return f"<body><div class='xqz'>{words(30)}</div><article><div class='social story'>{content}</div><div class='comments'>{words(12)}</div></article><div class='xqz b'>{words(20)}</div></body>"

    tags, marks = Counter(), Counter()
    for i in range(100):
        t, m = htmltext.counted(page(i))
        tags.update(t)
        marks.update(m)
    model = htmltext.weights_of(tags, marks)
    assert model.marks[".social"] > 0 > max(model.marks[".xqz"], model.marks[".comments"])
    for renamed in (False, True):
        got = want = both = 0
        for i in range(50):
            p = page(i)
            truth = Counter(x for m in re.finditer("<p>(.*?)</p>", p) for x in m[1].split())
            p = re.sub(r"<(/?)article", r"<\1div", p) if renamed else p
            found = Counter(htmltext.extract(p, model).split())
            got, want, both = got + found.total(), want + truth.total(), both + (found & truth).total()
        assert 2 * both / (got + want) > 0.97


def test_extraction_held_out():
    """Of pages that were not learned from, <article> renamed to div changes nothing."""
    pq = pytest.importorskip("pyarrow.parquet")
    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet")["html"].to_pylist()
    tags, marks = Counter(), Counter()
    for p in pages[::2]:
        if c := htmltext.counted(p):
            tags.update(c[0])
            marks.update(c[1])
    model = htmltext.weights_of(tags, marks)
    for p in pages[1::2]:
        text = htmltext.extract(p, model)
        assert text and htmltext.extract(re.sub(r"<(/?)(article|main)\b", r"<\1div", p), model) == text


def searched(keys, ids, q, x, block_keys, k=5, parts=100):
    s = topk.Search(keys, q, k)
    for at in range(0, len(x), parts):
        s.add(block_keys[at : at + parts], ids[at : at + parts], x[at : at + parts])
    return s, [[(int(i), int(v)) for i, v in zip(*b, strict=True)] for b in s.best]


def test_sorted_lists_against_brute_force():
    rng = np.random.default_rng(3)
    for n, d, high in ((300, 8, 4), (50, 3, 1000), (3, 2, 5), (700, 16, 100), (5, 0, 1)):
        x = rng.integers(-high, high + 1, (n, d)).astype(float)
        ids, keys = rng.permutation(n) // 2, np.arange(n)
        own = rng.choice(n, min(7, n), replace=False)
        _, got = searched(own, ids, x[own], x, keys)
        for r, found in zip(own, got, strict=True):
            want = sorted((-int(x[r] @ x[j]), int(ids[j])) for j in range(n) if j != r)[:5]
            assert [(-s, i) for i, s in found] == want
    big = np.array([[2.0**40, -5.0], [2.0**40 + 1, 2.0**40]])
    assert searched(np.array([0]), np.array([0, 1]), big[:1], big, np.arange(2))[1] == [[(1, 2**40 * (2**40 + 1) - 5 * 2**40)]]


def test_sorted_lists_are_read_in_part():
    """Where the lists agree, reading stops early; ties are read through."""
    rng = np.random.default_rng(4)
    x = np.floor(256 * rng.pareto(1.2, (4096, 1)) * rng.uniform(0.5, 1, (4096, 8)))  # the lists agree
    s, got = searched(np.arange(20), np.arange(4096), x[:20], x, np.arange(4096), parts=2048)
    assert 0 < s.read < 0.5 * s.all
    for i, found in enumerate(got):
        assert [v for _, v in found] == sorted((int(x[i] @ y) for j, y in enumerate(x) if j != i), reverse=True)[:5]
    same = np.ones((256, 4))
    s, got = searched(np.arange(1), np.arange(256), same[:1], same, np.arange(256), parts=256)
    assert got == [[(i, 4) for i in range(1, 6)]]


def replayed(queues, whole, length):
    """Deficit round-robin as in the book: every round visits every queue."""
    out, at, d = [], [0] * len(queues), [c * whole for _, c, _ in queues]
    while any(w > 0 and at[s] < len(sizes) for s, (w, _, sizes) in enumerate(queues)):
        for s, (w, _, sizes) in enumerate(queues):
            if w > 0 and at[s] < len(sizes):
                d[s] += w * length
                while d[s] > 0 and at[s] < len(sizes):
                    out.append((s, at[s]))
                    d[s] -= sizes[at[s]] * whole
                    at[s] += 1
    return out + [(s, i) for s, (w, _, sizes) in enumerate(queues) if w <= 0 for i in range(len(sizes))]


def test_round_robin_against_replay():
    rng = random.Random(6)
    for _ in range(200):
        queues = [(rng.choice([0, 1, rng.randint(1, 500)]), -rng.randint(0, 40), [rng.choice([1, 5, rng.randint(1, 90)]) for _ in range(rng.randint(0, 25))]) for _ in range(rng.randint(0, 6))]
        whole = sum(w for w, _, _ in queues) + rng.randint(0, 50)
        assert packing.served(queues, whole, 16) == replayed(queues, whole, 16)


def test_round_robin_keeps_shares():
    """After any document a queue that still waits is within a quantum and a document of its share."""
    rng = random.Random(7)
    sizes = [[rng.randint(1, 300) for _ in range(n)] for n in (400, 50, 900)]
    total = [sum(s) for s in sizes]
    order = packing.served([(t, 0, s) for t, s in zip(total, sizes, strict=True)], sum(total), 2048)
    took = [0, 0, 0]
    for s, i in order:
        took[s] += sizes[s][i]
        x = sum(took)
        for q in range(3):
            assert abs(took[q] - x * total[q] / sum(total)) <= 2048 + 3 * 300
    assert took == total


def test_pieces_tile_windows():
    rng = np.random.default_rng(8)
    n = rng.integers(1, 100, 200)
    doc, at, size, w, offset = packing.pieces(n, 32)
    assert (np.bincount(doc, weights=size) == n).all() and (np.bincount(w, weights=size)[:-1] == 32).all()
    place = w * 32 + offset
    assert list(place) == [0, *np.cumsum(size)[:-1]] and (at[doc == 0][0], at.max() < 100) == (0, True)
    assert all((at[doc == d] == np.cumsum(size[doc == d]) - size[doc == d]).all() for d in range(200))


def test_encoder_gives_the_librarys_ids():
    from tokenizers import Tokenizer

    json_path, ranks = packing.default_paths()
    e, t = packing.Encoder(json_path, ranks), Tokenizer.from_file(json_path)
    rng = random.Random(0)
    pool = ["the", " ", " ", "\n", "  ", "\t", "don't", "Ünï", "日本", "12", "!?", " ", "<|endoftext|>", "a", "\r\n", "😀", "\x1c", "ɐ"]
    texts = ["", " ", "\n", "plain words\nand lines here", "x " * 500] + ["".join(rng.choice(pool) for _ in range(rng.randint(1, 12))) for _ in range(1500)]
    for x in texts:
        assert list(np.frombuffer(e.encode(x), "<u2")) == t.encode(x, add_special_tokens=False).ids, repr(x)


def brute_set(text):
    w = text.encode().lower().split()
    return frozenset() if not w else frozenset([tuple(w)]) if len(w) < 5 else frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))


def test_shingles_and_links_against_sets():
    rng, s = random.Random(0), neardup.Shingler()
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 14))) for _ in range(120)] + ["A b", "a B", "a"]
    for a in texts[-30:]:
        for b in texts:
            x, y = brute_set(a), brute_set(b)
            assert len(s(a.encode())) == len(x)
            assert neardup.linked(s(a.encode()), s(b.encode())) == (bool(x and y) and 100 * len(x & y) >= 80 * len(x | y))
            assert (neardup.class_of(s(a.encode())) == neardup.class_of(s(b.encode()))) == (x == y)


def test_count_tree_loses_no_link():
    rng = np.random.default_rng(0)
    sets = []
    for _ in range(60):
        base = rng.integers(0, 2**63, rng.integers(5, 400)).astype(np.uint64)
        for _ in range(5):
            keep = rng.random(len(base)) < 0.95
            sets.append(np.unique(np.concatenate([base[keep], rng.integers(0, 2**63, rng.integers(0, 8)).astype(np.uint64)])))
    sets.sort(key=len)
    sizes, counts = np.array(list(map(len, sets))), neardup.counts_of([neardup.count_vector(s) for s in sets])
    assert (counts.sum(axis=1) >= sizes).all()
    got = {(int(q), int(p)) for a, b in neardup.CountTree(sizes, counts).search(sizes, counts, chunk=50) for q, p in zip(a, b, strict=True)}
    links = {(i, j) for i in range(len(sets)) for j in range(len(sets)) if neardup.linked(sets[i], sets[j])}
    assert links <= got and len(got) < len(sets) ** 2 / 4
    huge = np.arange(200_000, dtype=np.uint64) << np.uint64(20)
    assert (neardup.counts_of([neardup.count_vector(huge)]) >= 200_000 // neardup.GROUPS).all()


def test_language_model_sums_to_one_and_learns():
    words = [f"w{i}".encode() for i in range(30)] + [lm.END]
    head = [(w, lm.shape(w), 10) for w in words]
    v = lm.Vocabulary(head, {"total": 310, "distinct": 31}, {lm.shape(w): (10 * sum(lm.shape(x) == lm.shape(w) for x in words), sum(lm.shape(x) == lm.shape(w) for x in words)) for w in words})
    w = lm.start_weights(v)
    h = np.random.default_rng(0).normal(size=(1, lm.HIDDEN)).astype(np.float32)
    every = np.arange(lm.VOCABULARY + lm.SHAPES)
    lp = lm._outputs(w, np.repeat(h, len(every), axis=0), every, v.classes)
    assert abs(np.exp(lp).sum() - 1) < 1e-4
    text = b" ".join([b"w1", b"w2", b"w3", b"w4"] * 30)
    ids = lm.Reader(v)(pa.array([text.decode()]))[0]
    before = lm.score_batch(w, [ids], v.classes)[0]
    for _ in range(8):
        read = lm.train(w, [ids] * 70, v.classes)
    assert read == 70 * len(ids) and lm.score_batch(w, [ids], v.classes)[0] > before + 20
    # whole documents: one by one, in company and across windows the score is the same
    others = [ids[:1], ids[:40], ids]
    together = lm.score_batch(w, others, v.classes)
    assert np.allclose(together, [lm.score_batch(w, [x], v.classes)[0] for x in others], rtol=1e-4)


def test_gradients_of_the_language_model():
    v = lm.Vocabulary([(b"a", 6, 5), (b"b", 6, 5), (lm.END, 5, 5)], {"total": 15, "distinct": 3}, {6: (10, 2), 5: (5, 1)})
    w = {k: x.astype(np.float64) for k, x in lm.start_weights(v).items()}
    rng = np.random.default_rng(1)
    h = rng.normal(size=(6, lm.HIDDEN))
    x = np.array([0, 1, 2, lm.VOCABULARY, 1, 0])
    grad = {k: np.zeros_like(y) for k, y in w.items()}
    dh = lm._outputs(w, h, x, v.classes, grad)
    loss = lambda: -lm._outputs(w, h, x, v.classes).sum()
    for a, g, at in ((w["wc"], grad["wc"], (3, 1)), (w["wo"], grad["wo"], (1, 2)), (w["bo"], grad["bo"], (0,)), (h, dh, (4, 5))):
        old = a[at]
        a[at] = old + 1e-5
        up = loss()
        a[at] = old - 1e-5
        assert abs((up - loss()) / 2e-5 - g[at]) < 1e-4
        a[at] = old


def plain_language_model(w, classes, ids):
    """log P of each input of one document, step by step."""
    w = {k: x.astype(np.float64) for k, x in w.items()}
    n, h, out = lm.HIDDEN, np.zeros(lm.HIDDEN), []
    logistic = lambda y: 1 / (1 + np.exp(-y))
    log_softmax = lambda y: y - y.max() - math.log(np.exp(y - y.max()).sum())
    for x in ids:
        k = x // lm.CLASS if x < lm.VOCABULARY else classes + x - lm.VOCABULARY
        lp = log_softmax(h @ w["wc"] + w["bc"])[k]
        if x < lm.VOCABULARY:
            own = slice(k * lm.CLASS, (k + 1) * lm.CLASS)
            lp += log_softmax(w["wo"][own] @ h + w["bo"][own])[x % lm.CLASS]
        out.append(lp)
        g, hu = w["g"][x], h @ w["u"]
        z, r = logistic(g[:n] + hu[:n]), logistic(g[n : 2 * n] + hu[n : 2 * n])
        h = z * h + (1 - z) * np.tanh(g[2 * n :] + r * hu[2 * n :])
    return np.array(out)


@pytest.mark.parametrize(("block", "scale"), [(3, 1), (1024, 1), (7, 400)])
def test_language_model_against_a_plain_one(monkeypatch, block, scale):
    """Scores, and one step of training by numeric derivatives, in blocks of any size and with weights of any size."""
    monkeypatch.setattr(lm, "BLOCK", block)
    rng = np.random.default_rng(3)
    words = [f"w{i}".encode() for i in range(200)] + [lm.END]
    v = lm.Vocabulary([(w, lm.shape(w), 10) for w in words], {"total": 2010, "distinct": 201}, {lm.shape(w): (2010, 201) for w in words})
    w = lm.start_weights(v)
    w["wo"], w["wc"] = w["wo"] * 30 * scale, w["wc"] * 30
    docs = [rng.choice([*range(200), lm.VOCABULARY + 2, lm.VOCABULARY + 5], n).astype(np.int32) for n in (1, 20, 31, 9)]
    want = [plain_language_model(w, v.classes, d).sum() for d in docs]
    assert np.allclose(lm.score_batch(w, docs, v.classes), want, rtol=1e-4)
    if scale > 1:
        return
    loss = lambda w: -sum(plain_language_model(w, v.classes, d).sum() for d in docs) / sum(map(len, docs))
    moved = {k: x.copy() for k, x in w.items()}
    assert lm.train(moved, iter(docs), v.classes, 1.0) == sum(map(len, docs))
    for k, at in (("g", (docs[1][3], 2)), ("g", (docs[2][5], 20)), ("g", (docs[3][1], 40)), ("u", (1, 3)), ("u", (4, 19)), ("u", (7, 41)), ("wc", (2, 1)), ("wo", (docs[1][2] % 200, 3)), ("bc", (v.classes + 2,)), ("bo", (5,))):
        up, down = ({**w, k: w[k].astype(np.float64)} for _ in range(2))
        up[k][at] += 1e-4
        down[k][at] -= 1e-4
        g = (loss(up) - loss(down)) / 2e-4
        assert abs((w[k][at] - moved[k][at]) - g / math.sqrt(1e-6 + g * g)) < 2e-3, (k, at)


def test_shapes_of_columns_are_those_of_words(monkeypatch):
    """Words are classed by whole columns, without a call for each ASCII word."""
    rng, one = random.Random(16), lm.shape
    words = ["".join(rng.choice("abz09.,;:!?\"'()-#_~\x00\x1céßñ中") for _ in range(rng.randint(0, 6))).encode() for _ in range(4000)] + [b"", b"\xff\xfe", b"a\xff", b"\xe2\xc3\xa4"]
    want = list(map(one, words))

    def shape(word):
        assert not word.isascii()
        return one(word)

    monkeypatch.setattr(lm, "shape", shape)
    v = lm.Vocabulary([(lm.END, 5, 1)], {"total": 1, "distinct": 1}, {5: (1, 1)})
    assert list(lm.Reader(v)(pa.array(["x9 word. # one (a) größe"]))[0] - lm.VOCABULARY)[:-1] == [one(x.encode()) for x in "x9 word. # one (a) größe".split()]
    for column in (pa.array(words, pa.binary()), pa.array(words, pa.large_binary())):
        assert list(lm.shapes(column)) == want and list(lm.shapes(column.slice(17, 300))) == want[17:317] and len(lm.shapes(column[:0])) == 0


def test_shingles_of_many_texts_are_those_of_each():
    rng = random.Random(15)
    texts = ["".join(rng.choice(["A ", "b ", "É", "c d e f ", " ", "\n", "x y z x y z "]) for _ in range(rng.randint(0, 14))) for _ in range(2500)] + [None, "", "one"]
    one = neardup.Shingler()
    got = list(neardup.shingle_sets(pa.array(texts), 700))
    assert len(got) == len(texts) and all((g == one((t or "").encode())).all() and len(g) == len(one((t or "").encode())) for g, t in zip(got, texts, strict=True))


def test_tokens_of_texts_against_brute_force():
    rng = random.Random(10)
    texts = ["".join(rng.choice(["A", "b", "É", "é", " ", "\n", "\t", "\x0b", "\x0c", "\r", "\x1c", "\x85", "\xa0", "\u2003", "."]) for _ in range(rng.randint(0, 12))) for _ in range(3000)] + [None, ""]
    flat, n = lm.tokens(pa.array(texts))
    want = [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for t in texts]
    assert list(n) == list(map(len, want)) and flat.to_pylist() == [w for ws in want for w in ws]
    for at in [*range(0, 3000, 8), *range(1, 3000, 97)]:  # slices of any offset, as batches are cut
        flat, n = lm.tokens(pa.array(texts).slice(at, 300))
        assert list(n) == list(map(len, want[at : at + 300])) and flat.to_pylist() == [w for ws in want[at : at + 300] for w in ws]


def test_texts_of_one_kind_have_a_shape():
    assert all(0 <= lm.shape(w) < lm.SHAPES for w in (b"", b"a", b"\xff\xfe", "größe".encode(), "ção".encode(), b"x9", b"#", b"word."))


@pytest.mark.parametrize("text", [b"", b" \n ", b"one", "ünï cödé".encode(), b"a\x00b", b"x" * 100_000])
def test_kernels_take_any_text(text):
    quality.measure(text)
    neardup.Shingler()(text)
    lm.tokens(pa.array([text.decode()]))
    toxicity.parts(text)
