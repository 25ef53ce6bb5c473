"""op11 to op13: held-out accuracy, brute force over whole tables, defined edge cases."""

import random
import zlib

import numpy as np
import pytest
from brute import sha
from pyspark.sql import functions as F

from palisade.llm import centroids, quality, queries, runs


def all_runs(words, least=12):
    """Every run by comparing the words with themselves, shifted by every period."""
    names = {}
    a, out = np.array([names.setdefault(w, len(names)) for w in words], int), {}
    for q in range(1, len(a) // 2 + 1):
        equal = np.diff(np.concatenate([[0], (a[:-q] == a[q:]).astype(int), [0]]))
        for s, e in zip(np.flatnonzero(equal == 1), np.flatnonzero(equal == -1), strict=True):
            if e - s + q >= max(least, 2 * q):
                out.setdefault((int(s), int(e + q)), q)
    return sorted((s, e - s, q) for (s, e), q in out.items())


def random_words(rng):
    letters, n = rng.choice([1, 2, 3, 4, 8]), rng.randint(0, rng.choice([14, 30, 80, 200]))
    if rng.random() < 0.5:
        return [rng.randrange(letters) for _ in range(n)]
    word = []
    while len(word) < n:
        if word and rng.random() < 0.6:
            i = rng.randrange(len(word))
            word += word[i : i + rng.randint(1, 40)] * rng.randint(1, 3)
        else:
            word.append(rng.randrange(letters))
    return word


def test_runs_of_random_words():
    rng = random.Random(5)
    for _ in range(700):
        word = random_words(rng)
        for least in (12, rng.choice([2, 3, 4, 5, 7])):
            want = all_runs(word, least)
            assert runs.runs_of(list(word), least) == want
            cut = runs.pieces(np.array(word, np.int64), (least + 1) // 2)
            assert [(s + a, n, q) for s, e in cut for a, n, q in runs.runs_of(word[s:e], least)] == want


def test_runs_of_words_without_any():
    """Thue-Morse doubled: nearly every stretch is a square, and a square-free word has none."""
    morse = [bin(i).count("1") % 2 for i in range(3000)]
    assert runs.runs_of(morse) == all_runs(morse)
    free = [int(morse[i + 1]) - int(morse[i]) + 1 for i in range(2999)]
    assert runs.runs_of(free) == [] == all_runs(free)
    assert runs.pieces(np.arange(1000), 6) == []


def test_factors_are_the_longest():
    rng = random.Random(2)
    for _ in range(200):
        word = random_words(rng)
        at = 0
        for start, size, earlier in runs.factors(word):
            assert start == at
            found = [size for size in range(1, len(word) - at + 1) if any(word[p : p + size] == word[at : at + size] for p in range(at))]
            assert size == max(found, default=1) and (earlier == -1) == (not found)
            assert earlier < at and (earlier < 0 or word[earlier : earlier + size] == word[at : at + size])
            at += size
        assert at == len(word)


def planted(doc_id, words):
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    g = h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def test_periodic_runs_of_the_table(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    some = 0
    for r in queries.QUERIES["op12_periodic_runs"](spark, sf).collect():
        words = planted(r.doc_id, (texts[r.doc_id] or "").encode().split())
        want = all_runs(words)
        top = max(want, key=lambda x: (x[1], -x[0], -x[2]), default=None)
        gone = {i for s, n, q in want for i in range(s + q, s + n)}
        assert r.n_runs == len(want)
        assert (r.start, r.length, r.period, r.exponent_milli) == ((*top, 1000 * top[1] // top[2]) if top else (None,) * 4)
        assert r.runs_sha256 == sha("".join(f"{s},{n},{q}\n" for s, n, q in want))
        assert r.collapsed_sha256 == sha(b" ".join(w for i, w in enumerate(words) if i not in gone))
        some += len(want)
    assert some > 100


def test_periodic_runs_edges(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, " \t\n", "x"), (4, "a b " * 6, "x"), (4, "a b " * 6, "y"), (None, "a " * 11, "x"), (5, "ä b " * 12, None), (6, "w " * 100_000, "x"), (7, "a b " * 5 + "a", "x")]
    table = spark.createDataFrame(rows, "doc_id int, text string, runs string")
    got = sorted(((r.doc_id or 0, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in runs.periodic_runs(table).collect()), key=str)
    assert got == sorted(
        [(1, 0, [], ""), (2, 0, [], ""), (3, 0, [], ""), (4, 12, [(0, 12, 2)], "a b"), (4, 12, [(0, 12, 2)], "a b"), (0, 11, [], " ".join("a" * 11)), (5, 12, [(0, 12, 1)], "ä b"), (6, 100_000, [(0, 100_000, 1)], "w"), (7, 11, [], "a b a b a b a b a b a")],
        key=str,
    )
    assert runs.periodic_runs(table.where("false")).collect() == []


def lloyd(vectors, k=8, rounds=10):
    """vec_id -> cluster, distance; and the centroids: plain rounds over all distances, in Python's integers."""
    x = {v: [int(np.floor(1024 * np.float64(c))) for c in e] for v, e in vectors}
    at = [x[v] for v in sorted(x, key=lambda v: sha(f"3:{v}"))[:k]]

    def assigned():
        return {v: min((sum((a - b) ** 2 for a, b in zip(e, c, strict=True)), j) for j, c in enumerate(at)) for v, e in x.items()}

    for _ in range(rounds):
        own = assigned()
        for j in range(len(at)):
            mine = [x[v] for v, (_, c) in own.items() if c == j]
            if mine:
                at[j] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    return {v: (j, d) for v, (d, j) in assigned().items()}, at


def test_clusters_of_the_table(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    want, at = lloyd([(r.vec_id, r.embedding) for r in table.collect()])
    got = queries.QUERIES["op13_centroid_clusters"](spark, sf).collect()
    assert {r.vec_id: (r.cluster, r.distance) for r in got} == want and len(got) == len(want)
    own = [sum(d for j, d in want.values() if j == c) for c in range(8)]
    assert all((r.cluster_inertia, r.inertia, r.centroid_sha256) == (own[r.cluster], sum(own), sha(",".join(map(str, at[r.cluster])))) for r in got)


def test_bounds_skip_distances_and_keep_ties(spark):
    """Small integers make many ties; bounds must spare most distances of separate clusters."""
    rng = np.random.default_rng(3)
    tied = [(i, (rng.integers(-2, 3, 64) / 1024).tolist()) for i in range(400)]
    apart = [(i, (rng.normal(0, 0.01, 64) + 3 * np.eye(64)[i % 8]).tolist()) for i in range(800)]
    for vectors in (tied, apart):
        found, at = centroids.clustered(spark.createDataFrame(vectors, "vec_id long, embedding array<float>"))
        rows = found.collect()
        want, centres = lloyd([(v, [np.float32(c) for c in e]) for v, e in vectors])
        assert {r.vec_id: (r.cluster, r.distance) for r in rows} == want and at.tolist() == centres
    assert np.mean([r.computed for r in rows]) < 3  # of nine: the last round computes each vector's own


def test_elkan_against_all_distances():
    """Bounds carried over random moves of the centroids never lose the nearest one."""
    rng = np.random.default_rng(9)
    x, at = rng.integers(-40, 40, (500, 5)), rng.integers(-40, 40, (6, 5))
    centres = centroids.Centres(at)
    own, upper, lower, _, _ = centres.first(x)
    for step in range(30):
        at = at + rng.integers(-3, 4, at.shape) * (step % 3 > 0)
        centres = centroids.Centres(at, centres.at)
        own, upper, lower, best, _ = centres.next(x, own, upper, lower, step == 29)
        d = np.stack([centroids.squared(x, c) for c in at], 1)
        assert (own == d.argmin(1)).all()
        assert (upper.astype(float) ** 2 >= d[np.arange(500), own]).all() and (lower.astype(float) ** 2 <= d).all()
    assert (best == d.min(1)).all()


def test_clusters_edges(spark):
    one = [0.5] * 64
    rows = [(1, one, 0), (1, one, 1), (None, one, 2), (2, None, 3), (3, [], 4), (4, [*one[:63], None], 5), (5, [*one[:63], float("nan")], 6), (6, [float("inf")] * 64, 7), (7, [*one, 0.5], 8), (8, [1e30] * 64, 9), (9, [-0.0001] * 64, 10)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, cluster int")
    got = sorted((r.vec_id or 0, r.cluster, r.distance) for r in centroids.clustered(table)[0].collect())
    assert len(got) == 4 and all(r[2] == 0 for r in got) and got[1][1:] == got[2][1:] == got[0][1:]  # three seeds, two of them equal
    assert centroids.clustered(table.where("false"))[0].collect() == []
    assert centroids.clustered(table.where("vec_id is null"))[0].collect() == []


def test_quality_on_held_out_rows(spark, sf):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = queries.QUERIES["op11_quality_mil"](spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    known = [r for r in rows if r.held_out and labels.get(r.doc_id) is not None]
    assert np.mean([r.predicted == labels[r.doc_id] for r in known]) >= 0.96
    assert np.mean([r.predicted for r in known if labels[r.doc_id] == 1]) >= 0.97


def test_attention_finds_the_bad_passage():
    """One passage of many decides: a mean over passages would hide it."""
    rng = np.random.default_rng(4)
    good = lambda: " ".join("".join(rng.choice(list("abcdefgh"), rng.integers(2, 9))) for _ in range(quality.PASSAGE))
    bad = lambda: " ".join("".join(rng.choice(list("abcdefgh"), rng.integers(2, 9))) + rng.choice(["$$$", "&&&"]) for _ in range(quality.PASSAGE))

    def bags(n):
        y = rng.integers(0, 2, n)
        texts = []
        for label in y:
            parts = [good() for _ in range(12)]
            if not label:
                parts[rng.integers(12)] = bad()
            texts.append(quality.bag(" ".join(parts).encode()))
        return texts, y

    model = quality.AttentionModel.fitted(*bags(300))
    test, y = bags(100)
    assert ((model.scores(test) >= 0.5) == y).mean() >= 0.97
    hidden = next(b for b, label in zip(test, y, strict=True) if not label)
    weights = model.forward(model.scaled(hidden), np.array([0]))["a"]
    assert weights.max() > 2 / 12


def test_slopes_against_differences():
    rng = np.random.default_rng(8)
    model = quality.AttentionModel.fitted([rng.random((3, quality.WIDTH), np.float32) for _ in range(4)], np.array([0, 1, 0, 1]))
    x, starts, y = rng.normal(size=(7, quality.WIDTH)), np.array([0, 3, 4]), np.array([1, 0, 1])

    def loss():
        m = model.forward(x, starts)["margin"]
        return np.mean(np.log1p(np.exp(m)) - y * m)

    for name, slope in model.slopes(x, starts, y).items():
        w = model.weights[name] = np.array(model.weights[name], float)
        for at in [tuple(rng.integers(0, s) for s in w.shape) for _ in range(5)]:
            kept = w[at]
            w[at] = kept + 1e-5
            more = loss()
            w[at] = kept - 1e-5
            less = loss()
            w[at] = kept
            assert (more - less) / 2e-5 == pytest.approx(np.asarray(slope)[at], rel=1e-3, abs=1e-7)


def test_quality_edges(spark, monkeypatch):
    rows = [(1, "plain words in a line", 1), (1, "plain words in a line", 1), (2, "x$$$ y&&& z###", 0), (3, None, 0), (4, "", 0), (None, "plain words", 0), (5, " \n\t", 0), (6, "é" * 300_000 + "  ok", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    labels = spark.createDataFrame([(i, q) for i, q in ((1, 1), (2, 0), (99, 1), (None, 0), (3, None), (4, 5))], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    got = quality.scored(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id == 1}) == 1 and len({r.score for r in got if r.doc_id in (3, 4, 5)}) == 1
    assert quality.scored(docs.where("false"), model).collect() == []
    only = quality.fit(docs, labels.where("quality = 1"))
    assert {(r.score, r.predicted) for r in quality.scored(docs, only).collect()} == {(0.5, 0)}
    none = quality.fit(docs.where("false"), labels)
    assert {(r.score, r.predicted) for r in quality.scored(docs, none).collect()} == {(0.0, 0)}
    text = " ".join(f"w{i}" for i in range(3000)).encode()
    monkeypatch.setattr(quality, "PIECE", 1000)
    assert b"".join(quality.cut(text)) == text and max(map(len, quality.cut(text))) <= 1000
    assert len(b"".join(quality.cut(b"y" * 3500))) == 3500
    assert len(quality.bag(text)) >= 3000 // quality.PASSAGE
