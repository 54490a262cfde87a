"""Operators on small tables with nulls, empty and long texts, repeated rows and extra columns, against brute force."""

import hashlib
import json
import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumora.llm import components, htmltext, lm, mixing, neardup, packing, pii, quality, registry, secrets, topk, toxicity
from lumora.llm.common import fold_of, stored

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, score string, size string, row string, queue string"


@pytest.fixture(scope="module")
def texts(spark):
    return [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]


@pytest.fixture(scope="module")
def rows(texts):
    """Ordinary documents, and odd ones; columns that clash with the operators' own names."""
    odd = [(10**6, None, None), (10**6 + 1, "", "s"), (10**6 + 2, " \n\t", None), (10**6 + 3, "one", "s"), (10**6 + 4, "ONE", "s"), (10**6 + 5, "wort " * 30_000, "s"), (None, "no id at all " * 20, "t"), (10**6 + 5, "wort " * 30_000, "s"), (texts[0][0], texts[0][1], texts[0][2])]
    return [(i, t, "en", s, len(t or ""), "k", "s", "z", "r", "q") for i, t, s in [*texts[:120], *odd]]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SMALL}/labels.parquet").unionByName(spark.createDataFrame([(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int"), allowMissingColumns=True)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


@pytest.mark.parametrize("at_once", [lm.ROWS, 7])
def test_language_model(spark, docs, none, rows, monkeypatch, at_once):
    monkeypatch.setattr(lm, "ROWS", at_once)  # batches in several slices, too
    counts = lm.counted(docs)
    v = lm.vocabulary(counts)
    got = lm.score(docs, counts, v, lm.fit(docs, v)).collect()
    tokens = [([*words(lower(r[1])), "\n"], r[0]) for r in rows]
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 1
    c = Counter(t for ts, i in tokens if not held(i) for t in ts)
    n, k = sum(c.values()), len(c)
    want = Counter((i, held(i), len(ts), sum(c[t] > 0 for t in ts), n, f"{sum(math.log10((c[t] + 0.5) / (n + 0.5 * (k + 1))) for t in ts):.6g}") for ts, i in tokens)
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, f"{r.base_score:.6g}") for r in got) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    assert sum(r.score for r in got) > sum(r.base_score for r in got)
    empty = lm.counted(none)
    w = lm.vocabulary(empty)
    assert lm.score(none, empty, w, lm.fit(none, w)).count() == 0
    assert lm.score(docs, empty, w, lm.start_weights(w)).where("score >= 0 or isnan(score) or n_known != 0").count() == 0


def test_held_out_texts_teach_nothing(spark, docs, rows):
    """Other held-out texts leave the vocabulary and every weight as they are; two runs agree to the bit."""
    changed = spark.createDataFrame([(r[0], "only held out here " * 40, *r[2:]) if fold_of(r[0]) == 1 else tuple(r) for r in rows], SCHEMA).repartition(3)
    plain = spark.createDataFrame([tuple(r) for r in rows], SCHEMA).repartition(3)
    fits = []
    for df in (plain, plain, changed):
        df = stored(df)
        v = lm.vocabulary(lm.counted(df))
        fits.append((v, lm.fit(df.orderBy("doc_id", F.xxhash64("source")).coalesce(2), v)))
    for v, w in fits[1:]:
        assert v.words == fits[0][0].words and all((getattr(v, x) == getattr(fits[0][0], x)).all() for x in ("number", "count", "shape_mass"))
        assert all((w[k] == fits[0][1][k]).all() for k in w)


def test_copies_of_weights_are_averaged_in_a_tree(spark):
    rng = np.random.default_rng(0)
    x, n = rng.normal(size=(70, 2, 5)).astype(np.float32), rng.integers(1, 100, 70)
    df = stored(spark.createDataFrame([(i, b, float(n[i]), x[i, b].tobytes()) for i in range(70) for b in range(2)], "trainer int, block int, read double, w binary"))
    got = np.frombuffer(lm.averaged(df), np.float32).reshape(2, 5)
    assert np.allclose(got, np.einsum("t,tbk->bk", n / n.sum(), x), atol=1e-5)
    assert lm.averaged(df.where("false")) == b""


def test_every_training_document_is_trained_on(spark, docs, rows, monkeypatch, tmp_path):
    v, learn = lm.vocabulary(lm.counted(docs)), lm.train

    def train(w, ids, *a):
        read = learn(w, ids, *a)
        (tmp_path / os.urandom(8).hex()).write_text(str(read))
        return read

    monkeypatch.setattr(lm, "train", train)
    lm.fit(docs, v)
    want = sum(len(words(lower(t))) + 1 for i, t, *_ in rows if t is not None and fold_of(i) != 1)
    assert sum(int(f.read_text()) for f in tmp_path.iterdir()) == want


def test_rare_words_are_joined(spark, docs, monkeypatch):
    counts = lm.counted(docs)
    every, w = lm.vocabulary(counts), None
    w = lm.start_weights(every)
    want = {(r.doc_id, round(r.base_score, 6), r.n_known) for r in lm.score(docs, counts, every, w).collect()}
    monkeypatch.setattr(lm, "HEAD", 50)
    few = lm.vocabulary(counts)
    assert lm.VOCABULARY >= len(few.words) > 50 and len(few.words) < len(every.words)  # the head gives way to the vocabulary
    assert {(r.doc_id, round(r.base_score, 6), r.n_known) for r in lm.score(docs, counts, few, lm.start_weights(few)).collect()} == want


def brute_components(rows):
    def shingles(t):
        w = lower(t).encode().split()
        return frozenset() if not w else frozenset([tuple(w)]) if len(w) < 5 else frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))

    sets = [(r[0], shingles(r[1])) for r in rows]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                parent[find(i)] = find(j)
    least = defaultdict(lambda: math.inf)
    for i, (d, _) in enumerate(sets):
        least[find(i)] = min(least[find(i)], -math.inf if d is None else d)
    return Counter((d, len(s), None if least[find(i)] == -math.inf else least[find(i)]) for i, (d, s) in enumerate(sets))


def near_rows():
    """A chain of near copies, a passage that many share, sizes on the threshold."""
    base = [f"w{i}" for i in range(120)]
    out = []
    for k in range(60):
        w = list(base)
        for j in range(k):
            w[j * 2] = f"x{j}"
        out.append((1000 - k, " ".join(w)))
    passage = " ".join(f"p{i}" for i in range(60))
    out += [(2000 + k, " ".join(f"u{k}_{i}" for i in range(10 + 9 * (k % 9))) + " " + passage) for k in range(60)]
    for k in (7, 8, 9, 10, 11, 12):
        a = [f"t{k}_{i}" for i in range(44)]
        out += [(3000 + k, " ".join(a)), (4000 + k, " ".join(a[: 44 - k]))]
    return [(i, t, "en", "s", len(t), *"kszrq") for i, t in out]


@pytest.mark.parametrize(("frequent", "small"), [(40, 16), (2, 2), (10**9, 4)])
def test_near_duplicates(spark, docs, rows, monkeypatch, frequent, small):
    """The result doesn't depend on what counts as frequent or as a large meeting."""
    monkeypatch.setattr(neardup, "FREQUENT", frequent)
    monkeypatch.setattr(neardup, "SMALL", small)
    monkeypatch.setattr(neardup, "SPLIT", 16)
    if frequent == 40:
        got = neardup.near_duplicates(docs).collect()
        assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(rows)
        return
    more = near_rows()
    got = neardup.near_duplicates(spark.createDataFrame(more, SCHEMA)).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(more)


def test_near_duplicates_whose_names_collide(spark, monkeypatch):
    """Sets that share a 64-bit name are told apart by the second one, and all is done again with other names."""
    real = neardup.class_of
    monkeypatch.setattr(neardup, "class_of", lambda s, seed=0: len(s) if seed == 0 else real(s, seed))
    words_ = lambda tag, n: " ".join(f"{tag}{i}" for i in range(n))
    found = [(1, words_("a", 60)), (2, words_("b", 60)), (3, words_("b", 61)), (4, words_("b", 60)), (5, words_("c", 61))]
    got = neardup.near_duplicates(spark.createDataFrame(found, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(found)


def test_near_duplicates_with_ids_of_several_texts(spark):
    """Links are those of texts, whatever other texts have their ids."""
    many = lambda tag, n: " ".join(f"{tag}{i}" for i in range(n))
    found = [(11, "zz " + many("z", 100)), (11, "aa " + many("a", 100)), (12, "zz " + many("z", 99))]
    found += [(None, many("n", 100)), (None, many("m", 80)), (13, many("n", 99))]
    # two texts of an id that just fail the threshold; one of them has a near copy with a lesser id
    for k in range(10):
        shared = many(f"s{k}_", 178)
        found += [(100 + k, shared + " " + many(f"p{k}_", 22)), (100 + k, shared + " " + many(f"q{k}_", 22)), (50 + k, shared + " " + many(f"p{k}_", 21))]
    got = neardup.near_duplicates(spark.createDataFrame(found, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(found)


def test_near_duplicates_of_nothing_and_what_stays(docs, none, rows):
    assert neardup.near_duplicates(none).count() == 0
    kept = neardup.deduplicated(docs)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    assert ids == {c for _, _, c in brute_components(rows)}


def test_one_row_of_each_group_stays(spark):
    text = " ".join(f"w{i}" for i in range(100))
    other = " ".join(f"v{i}" for i in range(100))
    found = [(1, text), (1, text), (1, text + " end"), (2, text), (None, other), (None, other + " end"), (3, other), (1, "alone"), (1, ""), (1, ""), (None, None)]
    kept = neardup.deduplicated(spark.createDataFrame(found, "doc_id long, text string").repartition(3)).collect()
    assert Counter(r.doc_id for r in kept if (r.text or "").startswith("w")) == {1: 1}
    assert Counter(r.doc_id for r in kept if (r.text or "").startswith("v")) == {None: 1}
    assert Counter((r.doc_id, r.text) for r in kept if not r.text or r.text == "alone") == {(1, "alone"): 1, (1, ""): 2, (None, None): 1}


def test_components(spark):
    rng = np.random.default_rng(0)
    pairs = [(int(a), int(b)) for a, b in rng.integers(-50, 50, (60, 2))] + [(k, k + 1) for k in range(100, 160)] + [(7, 7), (200, 100), (200, 100)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    parent = {x: x for p in pairs for x in p}

    def find(x):
        return x if parent[x] == x else find(parent[x])

    for a, b in pairs:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    real = {x for a, b in pairs if a != b for x in (a, b)}
    assert got == {x: find(x) for x in real}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_toxicity(docs, none, labels, rows):
    got = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows) and all(0 <= r.score <= 1 for r in got)
    by = {(r[0], r[1]) for r in rows}
    for r in got:
        for s in r.spans:
            assert any(i == r.doc_id and words(t[s.start : s.end]) == [t[s.start : s.end]] for i, t in by if t)
    assert toxicity.score(none, toxicity.fit(none, labels)).count() == 0


def test_held_out_toxicity(spark):
    d, lab = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    some = d.join(lab.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0), "doc_id")
    scored = toxicity.score(some, toxicity.fit(d, lab, rows=800)).join(lab, "doc_id")
    n = Counter((int(r.score >= 0.5), r.toxic) for r in scored.collect())
    assert n[1, 1] / (n[1, 1] + n[0, 1]) > 0.75 and n[1, 0] / (n[1, 0] + n[0, 0]) < 0.02


def test_personal_data(docs, none, rows):
    got = pii.find_all(docs, pii.fit(docs)).collect()
    want = Counter()
    for r in rows:
        base = pii.base_spans(r[1] or "")
        n = Counter(k for _, k, _ in base)
        want[(r[0], n[0], n[1], n[2], n[3], hashlib.sha256(pii.written(base).encode()).hexdigest())] += 1
    assert Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got) == want
    assert pii.find_all(none, pii.fit(none)).count() == 0


def test_top_k(spark):
    rng = np.random.default_rng(0)
    vectors = [(i, [float(x) for x in rng.normal(0, 0.2, 6)]) for i in range(160)] + [(500, None), (501, [1.0, None]), (502, [math.nan] * 6), (503, [math.inf] * 6), (None, [1.0] * 6), (504, []), (505, [9.0, 9.0]), (0, None), (7, [0.0] * 6)]
    vectors = [(i, v, "x") for i, v in vectors] + [(600, [0.25] * 6, "x"), (601, [0.25] * 6, "x"), (650, [0.25] * 6, "x")]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>, score string")
    vectors += [(700, [0.5] * 6, "y"), (700, [0.25] * 6, "y"), (50, [0.1] * 6, "y")]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>, score string")
    sound = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v, _ in vectors if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = Counter()
    for r, (i, v) in enumerate(sound):
        if i % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), j) for t, (j, w) in enumerate(sound) if t != r)[:5]
            want.update((i, k + 1, j, -s) for k, (s, j) in enumerate(best))
    for pass_bytes in (topk.PASS_BYTES, 100):
        assert Counter(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 50 == 0, pass_bytes=pass_bytes).collect()) == want
    assert topk.top_k(df.where("false"), F.col("vec_id") % 50 == 0).count() == 0
    assert topk.top_k(df, F.col("vec_id") < 0).count() == 0


def test_top_k_of_wide_scores(spark):
    """Scores beyond 64 bits are ranked as they are and returned as the nearest long."""
    df = spark.createDataFrame([(0, [1e7, 1e7]), (1, [3e12, 0.0]), (2, [4e12, 0.0]), (3, [-1e300, 0.0]), (4, [1.0, 2.0]), (5, [0.0, 1e300])], "vec_id long, embedding array<double>")
    got = [(r.vec_id, r.score) for r in topk.top_k(df, F.col("vec_id") == 0).orderBy("rank").collect()]
    exact = lambda v: sum(int(256 * 1e7) * int(256 * x) for x in v)
    assert got == [(5, 2**63 - 1), (2, min(2**63 - 1, exact([4e12, 0]))), (1, min(2**63 - 1, exact([3e12, 0]))), (4, exact([1, 2])), (3, -(2**63))]


def test_secrets(spark, docs, none):
    planted = [(1, f"key AKIA{'AB12CD34EF56GH78'} ends"), (2, 'set token = "1beb58b8af68854f0e01b4ad40cdbb6ae7f578ae" é'), (3, "ééé password=b7db7aa4a5fcc78305 and password=b7db7aa4a5fcc78305"), (4, None), (5, ""), (6, "a plain text of wordsthatarelongenoughtolooklikeone and http://www.example.com/path-of-things/2024/page"), (7, "thing " * 50_000)]
    df = spark.createDataFrame([(i, t, 1) for i, t in planted], "doc_id long, text string, start int")
    forest = secrets.fit(docs)
    got = {(r.doc_id, r.start, r.end): r.value for r in secrets.scan(df, forest).select("doc_id", F.explode("findings").alias("f")).select("doc_id", "f.*").collect()}
    text = dict(planted)
    assert sorted(got) == [(1, 4, 24), (2, 13, 53), (3, 13, 31), (3, 45, 63)]
    assert all(text[i][a:b] == v for (i, a, b), v in got.items())
    masked = {r.doc_id: r.text for r in secrets.redact(df, forest).collect()}
    assert masked[3] == "ééé password=[SECRET] and password=[SECRET]" and masked[4] is None and masked[6] == text[6]
    assert secrets.scan(none, forest).count() == 0 and secrets.redact(docs, forest).columns == docs.columns
    plan = secrets.scan(docs, forest)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan.split("InMemoryRelation")[0] and not re.search("Python|Pandas|Arrow", plan)


def test_secret_candidates_against_brute_force(spark):
    """Positions, values and surroundings of candidates, by another regular expression engine, in texts of random parts."""
    regex = pytest.importorskip("regex")
    rng = random.Random(9)
    parts = ["password", "api-key", "ApiKey", "access_key", "token", "=", ":", '"', "'", " ", "\n", "\x01", "é", "a1", "ABCDEFGHIJKLMNOPQ", "x" * 15, "9" * 17, "abcdef0123456789AB", "==", "/", "-", "_", ".", ",", "hunter22", "zzz"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(1500)] + [" ".join(f"k{i}=abcdef0123456789{i} token: q{i}w2e3." for i in range(3000)), None, ""]
    cut = secrets.pieces(F.col("text"))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, text string").withColumn("p", cut)
    got = {r.i: [(c.value, c.start, c.before, c.after) for c in r.c] for r in df.select("i", F.coalesce(secrets.candidates(F.col("p")), F.array()).alias("c")).collect()}
    for i, t in enumerate(texts):
        t, want, last = (t or "").replace("\x01", " "), [], 0
        spans = [m.span(2) if m[2] is not None else m.span(3) for m in regex.finditer(secrets.CANDIDATE, t)]
        for k, (a, b) in enumerate(spans):
            end = spans[k + 1][0] if k + 1 < len(spans) else len(t)
            want.append((t[a:b], a, t[last:a][-48:], t[b:end][:16]))
            last = b
        assert got[i] == want


def test_secret_forest_and_redaction(spark, docs):
    """The forest as SQL votes as the model does; no secret leaves a tail, whichever begins like another."""
    from pyspark.ml.functions import vector_to_array

    rows = secrets.labelled(docs).cache()
    data = secrets.featured(rows)
    model = secrets.grown(data)
    x = F.struct(*[vector_to_array("v")[i].alias(f) for i, f in enumerate(secrets.FEATURES)]).alias("x")
    both = model.transform(data).select("v", x, "prediction", F.col("label").alias("y")).select("v", "prediction", "y", F.expr(secrets.as_sql(model)).alias("score")).collect()
    assert len(both) > 2000 and sum((r.score >= 0.5) == (r.prediction == 1) for r in both) >= 0.99 * len(both)  # the model weighs leaves, we count trees
    assert all(abs(r.score - sum(t.predict(r.v) for t in model.trees) / secrets.TREES) < 1e-9 for r in both[::97])
    assert sum((r.score >= 0.5) == (r.y == 1) for r in both) >= 0.98 * len(both)
    short, long_ = "abcd1234efgh5678ijkl", "abcd1234efgh5678ijklMNOP9"
    df = spark.createDataFrame([(1, f"{short} and {long_} and {short}", "y", 3), (1, f"{short} and {long_} and {short}", "y", 3), (2, "none\x01here", None, 4), (3, None, "z", None)], "doc_id long, text string, pieces string, n_chars int")
    got = sorted((r.doc_id, r.text, r.pieces, r.n_chars) for r in secrets.redact(df, "1.0D").collect() if r.text)
    masked = "[SECRET] and [SECRET] and [SECRET]"
    assert got == [(1, masked, "y", len(masked))] * 2 + [(2, "none\x01here", None, 4)]
    assert secrets.redact(df, "1.0D").where("text is null").count() == 1


def test_packing(docs, none, rows):
    got = packing.pack(docs, length=64).collect()
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_paths()[0])
    ids = {(r[0], r[1]): [*t.encode(r[1] or "", add_special_tokens=False).ids, 1] for r in rows}
    total = sum(len(ids[r[0], r[1]]) for r in rows)
    windows = defaultdict(list)
    for r in got:
        windows[r.sequence_id].append((r.offset, r.length))
    last = {}
    for k in windows:
        last[k >> 32] = max(k, last.get(k >> 32, 0))
    assert len(last) == -(-total // (64 * packing.LANE))
    for k, pieces in windows.items():
        at = 0
        for o, n in sorted(pieces):
            assert o == at
            at += n
        assert at == 64 or k in last.values() and at < 64
    # every document comes out whole, as often as it came in
    have = Counter()
    for r in got:
        have[r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens] += 1
    seen = Counter()
    for (i, s, n, crc, size), k in have.items():
        x = next(v for (d, _), v in ids.items() if d == i and len(v) == size)
        assert zlib.crc32(np.asarray(x[s : s + n], "<u4").tobytes()) == crc
        seen[i] += n * k
    assert seen == Counter(dict(sum((Counter({r[0]: len(ids[r[0], r[1]])}) for r in rows), Counter())))
    # documents are cut at window ends only
    assert len(got) <= len(rows) + total // 64 + len(last)
    assert packing.pack(none).count() == 0


@pytest.mark.parametrize("weights", [None, {"web": 3.0, None: 1.0, "s": 0.5}])
def test_packing_against_replay(spark, docs, weights):
    """Whatever the partitions, the pieces are those of a replay over the whole table: queues, lanes, rounds, cuts."""
    from tests.llm.test_models import replayed

    table_ = [(r.doc_id, r.text, r.source) for r in docs.coalesce(1).collect()]
    e = packing.Encoder(*packing.default_paths())
    sizes = [len(e.encode(t or "")) // 2 + 1 for _, t, _ in table_]
    name = lambda s: "" if s is None else "=" + s
    queues = defaultdict(list)
    for i, (_, _, s) in enumerate(table_):
        queues[name(s)].append(i)
    hashed = {r.q: r.h for r in spark.createDataFrame([(q,) for q in queues], "q string").select("q", F.xxhash64("q", F.lit(23)).alias("h")).collect()}
    total = {q: sum(sizes[i] for i in own) for q, own in queues.items()}
    weight = total if weights is None else {q: 0 for q in queues} | {name(s): round(w * 2**20) for s, w in weights.items()}
    whole, lanes = sum(weight.values()), max(1, -(-sum(sizes) // (16 * 32)))
    parts = [defaultdict(list) for _ in range(lanes)]
    for q, own in queues.items():
        at = hashed[q] % total[q]
        for i in own:
            start = at % total[q]
            parts[min(lanes - 1, int(start / (total[q] / lanes)))][q].append((start, i))
            at += sizes[i]
    want = Counter()
    for number, part in enumerate(parts):
        names = sorted(part)
        lists = [sorted(part[q]) for q in names]
        order = replayed([(weight[q], math.floor(number * (total[q] / lanes)) - x[0][0], [sizes[i] for _, i in x]) for q, x in zip(names, lists, strict=True)], whole, 32)
        at = 0
        for s, k in order:
            i, start = lists[s][k][1], 0
            while start < sizes[i]:
                n = min(sizes[i] - start, 32 - at % 32)
                want[table_[i][0], start, n, sizes[i], (number << 32) + at // 32, at % 32] += 1
                start, at = start + n, at + n
    for frame in (docs, docs.coalesce(1)):
        got = packing.pack(frame, length=32, lane=16, weights=weights).collect()
        assert Counter((r.doc_id, r.start, r.length, r.doc_tokens, r.sequence_id, r.offset) for r in got) == want


def test_extraction_on_a_table(spark):
    pages = [(1, "u", "<article><p>Hello &amp; bye</p></article>", 1), (2, None, None, 2), (None, "v", "", 3), (1, "u", "<article><p>Hello &amp; bye</p></article>", 1)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, text int")
    got = Counter(tuple(r) for r in htmltext.main_text(df, htmltext.fit(df)).collect())
    assert got == Counter({(1, "u", "Hello & bye", 11): 2, (2, None, "", 0): 1, (None, "v", "", 0): 1})
    assert htmltext.main_text(df.where("false"), htmltext.fit(df.where("false"))).count() == 0


def brute_targets(sizes):
    """Shares again what is above the cap until nothing is."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, active, out = 1.5 * sum(sizes.values()), set(order), {}
    while active:
        level = left / sum(weight[s] for s in active)
        over = {s for s in active if level * weight[s] > 2 * sizes[s]}
        if not over:
            return out | {s: level * weight[s] for s in active}
        for s in over:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        active -= over
    return out


def test_mixing(spark, docs, none, rows):
    got = mixing.mix(docs).collect()
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(words(r[1]))
    want = brute_targets(sizes)
    assert Counter((r.doc_id, r.size) for r in got) == Counter((r[0], len(words(r[1]))) for r in rows)
    taken, largest = Counter(), Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1, r.target) and r.taken in (0, r.size, 2 * r.size)
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    assert all(abs(taken[s] - want[s]) <= largest[s] for s in sizes)
    again = mixing.mix(docs.repartition(7)).collect()
    assert Counter((r.doc_id, r.dup, r.taken) for r in got) == Counter((r.doc_id, r.dup, r.taken) for r in again)
    assert mixing.mix(none).count() == 0
    out = mixing.mixed(docs)
    assert out.columns == docs.columns and out.count() == sum(r.copies for r in got)


def test_large_sources_come_close_to_their_targets_without_bias(spark):
    df = spark.range(6000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.pmod(F.xxhash64("id"), F.lit(400)) + 1).cast("int")).alias("text"), F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 3 == 1, "b").alias("source"))
    df = stored(df)
    got = mixing.mix(df).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.avg("copies").alias("copies"), F.first("source_size").alias("size")).collect()
    for r in got:
        assert abs(r.taken - r.target) <= 60 and abs(r.copies - r.target / r["size"]) < 0.05


def test_quality(docs, none, labels, rows):
    model = quality.fit(docs, labels)
    judged = quality.judge(docs, model)
    assert [c for c in judged.columns if c in docs.columns] == [c for c in docs.columns if c != "kept"] + ["kept"]
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in judged.collect())
    want = Counter()
    for r in rows:
        b = quality.measure((r[1] or "").encode())[0]
        want[(r[0], *b, b.n_words < 50 or 100 * b.n_repeat_words > 50 * b.n_words)] += 1
    assert got == want and judged.where("base_failed and kept").count() == 0
    assert quality.judge(none, quality.fit(none, labels)).count() == 0


def test_held_out_quality(spark):
    d, lab = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = quality.fit(d, lab, rows=500)
    n = Counter((r.kept, r.quality) for r in quality.judge(d.select("doc_id", "text"), model).where("not base_failed").join(lab, "doc_id").collect())
    assert n[True, 1] / (n[True, 1] + n[False, 1]) > 0.99 and n[False, 0] / (n[False, 0] + n[True, 0]) > 0.95


def test_pipeline(spark):
    import corpus_pipeline as P

    assert [n for n, _ in P.STAGES] == ["quality rules", "near duplicates", "secret scan", "source mixing", "packing"] and P.ORACLE_SQL is None
    d = spark.read.parquet(f"{SMALL}/documents.parquet")
    before, columns = {r.doc_id: r for r in d.collect()}, d.columns
    frames = []
    for _, stage in P.STAGES:
        d = stored(stage(spark, d, SMALL))
        frames.append(d)
    assert all(f.columns == columns for f in frames[:-1])
    ids = [Counter(r.doc_id for r in f.select("doc_id").collect()) for f in frames]
    assert set(ids[0]) < set(before) and all(quality.measure(before[i].text.encode())[0].failed is False for i in ids[0])
    reps = {c for _, _, c in brute_components([(i, before[i].text) for i in ids[0]])}
    assert set(ids[1]) == reps and max(ids[1].values()) == 1
    assert ids[2] == ids[1]
    for r in frames[2].collect():
        assert r.text == before[r.doc_id].text or secrets.MASK in r.text
    assert set(ids[3]) <= set(ids[2]) and max(ids[3].values()) <= 2
    tokens = sum(r.length for r in frames[4].collect())
    e = packing.Encoder(*packing.default_paths())
    assert tokens == sum(len(e.encode(r.text)) // 2 + 1 for r in frames[3].collect())
    assert P.run(spark, SMALL).count() == frames[4].count()


def test_pipeline_takes_any_rows(spark, docs, none, rows, tmp_path):
    """Nulls, empty and very long texts, ties, repeated rows, extra columns with clashing names, and empty tables, through every stage."""
    import corpus_pipeline as P

    spark.read.parquet(f"{SMALL}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    extra = [*"__k __row found pieces kept_ x h".split(), "of_id", "row_"]
    odd = docs.select("*", *[F.lit(1).alias(c) for c in extra])
    d = stored(odd)
    before, counts = Counter((r.doc_id, r.text) for r in d.collect()), []
    for name, stage in P.STAGES[:-1]:
        d = stored(stage(spark, d, str(tmp_path)))
        assert d.columns == odd.columns, name
        counts.append(d.count())
        if name in ("quality rules", "near duplicates"):
            assert not Counter((r.doc_id, r.text) for r in d.collect()) - before, name
    assert 0 < counts[1] == counts[2] < counts[0] < len(rows)
    # a stage on rows that its predecessor would have dropped
    for name, stage in P.STAGES[1:-1]:
        out = stage(spark, stored(odd), str(tmp_path))
        assert out.columns == odd.columns, name
        ids = Counter(r.doc_id for r in out.select("doc_id").collect())
        if name == "secret scan":
            assert ids == Counter(r[0] for r in rows)
    pieces = P.STAGES[-1][1](spark, stored(odd), str(tmp_path)).collect()
    assert Counter(r.doc_id for r in pieces if r.start == 0) == Counter(r[0] for r in rows)
    for name, stage in P.STAGES:
        assert stage(spark, stored(odd.where("false")), str(tmp_path)).count() == 0, name
    odd.where("false").write.parquet(str(tmp_path / "documents.parquet"))
    assert P.run(spark, str(tmp_path)).count() == 0


def test_registry():
    import __spark_entry__ as entry

    assert set(registry.QUERIES) | {"pipeline"} <= set(entry.queries()) and set(registry.ORACLE_SQL) <= set(registry.QUERIES)
    assert sorted(int(q[2:].split("_")[0]) for q in registry.QUERIES) == list(range(1, 11))


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_oracles(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    df = registry.QUERIES[name](spark, SMALL)
    q = con.execute(registry.ORACLE_SQL[name])
    titles = [x[0] for x in q.description]
    assert sorted(df.columns) == sorted(titles)
    assert sorted(map(tuple, df.select(*titles).collect())) == sorted(q.fetchall())


@pytest.mark.parametrize("name", ["op3_toxicity", "op4_personal_data", "op6_secret_scan", "op8_html_extraction", "op9_source_mixing", "op10_quality_rules"])
def test_queries_have_the_promised_columns(spark, name):
    wanted = {
        "op3_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
        "op4_personal_data": {"doc_id": "bigint", "n_email": "bigint", "n_ip": "bigint", "n_card": "bigint", "n_phone": "bigint", "base_sha256": "string", "spans": "string"},
        "op6_secret_scan": {"doc_id": "bigint", "start": "bigint", "end": "bigint", "value": "string", "score": "double"},
        "op8_html_extraction": {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"},
        "op9_source_mixing": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
        "op10_quality_rules": {"doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean"},
    }[name]
    df = registry.QUERIES[name](spark, SMALL)
    kinds = dict(df.dtypes)
    assert {k: kinds.get(k) for k in wanted} == wanted
    if name == "op3_toxicity":
        assert all(isinstance(json.loads(r.spans), list) for r in df.limit(5).collect())
