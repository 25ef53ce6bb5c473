"""Nulls, empty and long texts, ties, repeats, empty tables and clashing columns, for every operator and stage."""

import hashlib

import numpy as np
import pytest
from brute import sha
from pyspark.sql import functions as F
from pyspark.sql import types as T

import corpus_pipeline
from palisade.llm import bpe, chat, embeddings, exact_dedup, lines, minhash, mixing, pii, secrets, store, toxicity

LONG = "word " * 30_000 + "énd"
ROWS = [(1, None), (2, ""), (3, "same text here"), (3, "same text here"), (4, LONG), (None, "no id"), (5, "same text here"), (6, "same\ttext \n here"), (7, "x\ny\nx"), (8, "one"), (9, LONG + " more")]
EXTRA = ["kept", "h", "norm", "sha", "size", "key", "digest", "n", "component", "spans", "row", "base", "rank", "cell", "y", "terms"]


@pytest.fixture(scope="module")
def docs(spark):
    kind = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("source", T.StringType()), T.StructField("lang", T.StringType())])
    df = spark.createDataFrame([(i, t, None if k % 3 == 0 else f"s{k % 2}", "en") for k, (i, t) in enumerate(ROWS)], kind)
    return df.withColumns({c: F.lit(c) for c in EXTRA})


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 0, 1), (3, 1, 0), (99, 1, 1), (None, 1, 1), (4, None, None)], "doc_id long, quality int, toxic int")


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_exact(docs, empty):
    rows = exact_dedup.exact_groups(docs).collect()
    assert len(rows) == len(ROWS)
    got = {r.doc_id: r for r in rows}
    assert (got[1].keep_id, got[2].keep_id, got[2].kept, got[1].group_size) == (1, 1, False, 2)
    assert (got[5].keep_id, got[5].group_size, got[5].kept) == (3, 4, False)
    assert got[6].keep_id == 3 and got[6].text_sha256 == sha("same text here")
    assert got[None].kept and got[None].keep_id is None
    assert exact_dedup.exact_groups(empty).collect() == []


def test_exact_compares_bytes(docs, monkeypatch):
    """With a hash on which everything collides the classes are still those of the bytes."""
    monkeypatch.setattr(exact_dedup.F, "md5", lambda c: F.when(F.col(c) == "?", "00").otherwise("00"))
    got = {r.doc_id: r.keep_id for r in exact_dedup.exact_groups(docs).collect()}
    assert (got[2], got[4], got[5], got[7], got[8]) == (1, 4, 3, 7, 8)


def test_mixing(docs, empty, spark):
    rows = mixing.mixed(docs).collect()
    assert len(rows) == len(ROWS) and all(r.taken == r.copies * r.size and 0 <= r.copies <= 2 for r in rows)
    assert {r.doc_id: r.size for r in rows}[1] == 0
    assert mixing.mixed(empty).collect() == []
    again = mixing.mixed(docs).collect()
    assert sorted(map(repr, rows)) == sorted(map(repr, again))


def test_mixing_takes_near_targets(spark):
    rng = np.random.default_rng(0)
    sizes = [int(x) for x in rng.integers(0, 60, 3000)] + [20] * 1500  # half of one source has one size
    df = spark.createDataFrame([(i, "w " * n, "hot" if i >= 1500 else f"s{i % 5}") for i, n in enumerate(sizes)], "doc_id long, text string, source string")
    found = mixing.mixed(df).join(df.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target"), F.max("source_size").alias("n"), F.sum("size").alias("size")).collect()
    assert all(abs(r.taken - r.target) <= 60 and r.target <= 2 * r.n and r.size == r.n for r in found)
    assert abs(sum(r.target for r in found) - 1.5 * sum(sizes)) < 1e-6


def test_water_level(spark):
    src = spark.createDataFrame([("a1", 10), ("a2", 100), ("a3", 1000), ("z", 10)], "skey string, source_size long")
    got = {r.skey: r.target for r in mixing.targets(src).collect()}
    # weights 5, 2, 1, 5; 1680 to share: the small ones are full at 20, 200 and 20, the rest goes to a3
    assert got == {"a1": 20.0, "a2": 200.0, "a3": 1440.0, "z": 20.0}


def test_chat(spark):
    kind = "conv_id long, turn long, role string, text string, turns string, messages string"
    rows = [(1, 0, "user", "a<|end|>\\l", "", ""), (1, 1, "user", None, "", ""), (1, 2, "assistant", "<|next|>", "", ""), (1, 3, "assistant", "\\", "", ""), (1, 3, "assistant", "\\", "", ""), (2, None, None, "<", "", ""), (None, 0, "user", "|x", "", "")]
    out = chat.formatted(spark.createDataFrame(rows, kind))
    back = {r.conv_id: r for r in chat.read_back(out).collect()}
    assert [(t.role, t.text) for t in back[1].turns] == [("user", "a<|end|>\\l"), ("user", ""), ("assistant", "<|next|>"), ("assistant", "\\"), ("assistant", "\\")]
    assert back[1].loss_text == "<|next|>\\\\" and back[2].loss_text == "" and [(t.role, t.text) for t in back[2].turns] == [("", "<")]
    assert back[1].formatted.count("<|start|>") == 2 and back[1].formatted.count("<|next|>") == 3
    assert chat.formatted(spark.createDataFrame([], kind)).collect() == []


def test_chat_in_linear_time(spark):
    import time

    def took(n, role):
        rows = spark.range(n).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.concat(F.lit("text <| "), F.col("id")).alias("text"))
        began = time.perf_counter()
        r = chat.read_back(chat.formatted(rows)).first()
        took = time.perf_counter() - began
        texts = [f"text <| {i}" for i in range(n)]
        assert [t.text for t in r.turns] == texts and r.loss_text == "".join(t for t, turn in zip(texts, r.turns, strict=True) if turn.role == "assistant")
        return took

    for role in (F.when(F.col("id") % 2 == 0, "user").otherwise("assistant"), F.lit("assistant")):
        took(1000, role)
        assert took(40_000, role) < 3 * max(1.0, took(20_000, role))


def test_running_totals(spark):
    from palisade.llm.arrays import running_max, running_sum

    for n in (0, 1, 31, 32, 33, 1024, 1025, 40_000):
        rows = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: (i * 7919) % 1000).cast("array<long>").alias("v") if n else F.array().cast("array<long>").alias("v"))
        v, sums, most = rows.select("v", running_sum(F.col("v")), running_max(F.col("v"))).first()
        assert sums == np.cumsum(v).tolist() and most == np.maximum.accumulate(np.array(v, int)).tolist()


def test_bpe(docs, empty):
    import public_tokenizers as P
    import tiktoken

    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    rows = bpe.digests(docs).collect()
    assert len(rows) == len(ROWS) and sorted(map(repr, rows)) == sorted(map(repr, bpe.digests(docs, block_words=2, block_chars=100, replayed=3).collect()))
    for r in rows:
        text = dict(ROWS)[r.doc_id] or ""
        assert r.n_tokens == len(own.encode_ordinary(text)) and r.decoded_sha256 == sha(text)
    assert bpe.digests(empty).collect() == []


def test_toxicity(docs, empty, labels):
    model = toxicity.fit(docs, labels)
    rows = toxicity.scored(docs, model).collect()
    assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.scored(empty, model).collect() == []
    nothing = toxicity.fit(docs, labels.where("false"))
    assert {r.score for r in toxicity.scored(docs, nothing).collect()} == {0.0}


def test_pairs_count_beyond_single_terms():
    """An insult alone or a group alone is class 0, both together class 1: no additive model can tell."""
    rng = np.random.default_rng(1)
    docs, y = [], []
    for k in range(1200):
        insult, group = rng.random(2) < 0.5
        noise = rng.integers(10, 900, 8)
        docs.append(np.unique(np.concatenate([[901] * int(insult), [902] * int(group), noise]).astype(np.int64)))
        y.append(int(insult and group))
    model = toxicity.FactorizationMachine.fitted(docs, np.array(y))
    assert {901, 902} <= set(model.terms.tolist())
    at = {int(t): i for i, t in enumerate(model.terms)}
    w, v = model.weights, model.factors
    assert v[at[901]] @ v[at[902]] > 0 and model.margin([at[901], at[902]]) > max(model.margin([at[901]]), model.margin([at[902]]))


def test_pairs_with_a_term_neutral_alone():
    """30 % of texts hold an insult, 70 % a group, toxic are those with both: the group's own ratio is far below LIFT."""
    rng = np.random.default_rng(2)
    docs, y = [], []
    for _ in range(3000):
        insult, group = rng.random() < 0.3, rng.random() < 0.7
        docs.append(np.unique(np.concatenate([[901] * int(insult), [902] * int(group), rng.integers(1000, 9000, 25)]).astype(np.int64)))
        y.append(int(insult and group))
    y = np.array(y)
    model = toxicity.FactorizationMachine.fitted(docs[:2000], y[:2000])
    assert {901, 902} <= set(model.terms.tolist())
    at = {int(t): i for i, t in enumerate(model.terms)}
    said = np.array([model.margin([at[t] for t in d.tolist() if t in at]) > 0 for d in docs[2000:]])
    assert np.mean(said == y[2000:]) >= 0.97


def test_toxicity_margin_is_the_sum_over_pairs():
    """The model's closed form against a loop over all pairs."""
    rng = np.random.default_rng(4)
    model = toxicity.FactorizationMachine(np.arange(20), 0.3, rng.normal(size=20), rng.normal(size=(20, 4)))
    for _ in range(20):
        rows = sorted(rng.choice(20, rng.integers(0, 12), replace=False).tolist())
        want = 0.3 + sum(model.weights[i] for i in rows) + sum(model.factors[i] @ model.factors[j] for i in rows for j in rows if i < j)
        assert abs(model.margin(rows) - want) < 1e-9


def test_near_copies_are_learnt_once():
    rng = np.random.default_rng(3)
    docs = [np.unique(rng.integers(0, 1 << 32, 200)) for _ in range(50)]
    copies = [np.sort(np.concatenate([d[5:], rng.integers(0, 1 << 32, 5)])) for d in docs]  # similarity of about 0.95
    half = [np.sort(np.concatenate([d[100:], rng.integers(0, 1 << 32, 100)])) for d in docs]  # of about 0.33
    kept = toxicity.without_copies(docs + copies + half, np.zeros(150, int), 1)
    assert kept[:50] == list(range(50)) and len(kept) == 100 and set(range(100, 150)) <= set(kept)


@pytest.mark.parametrize("planted", [0, 5, 40, 400])
def test_unlabelled_secrets_in_the_sample_do_not_hide_others(planted):
    import random

    rng = random.Random(99)
    key = lambda: "".join(rng.choices(secrets.ALPHABET[:62], k=rng.randint(24, 40)))
    fresh, words = [key() for _ in range(1000)], [f"{a}-{b}{n}" for a in secrets.ORDINARY[:60] for b in secrets.ORDINARY[60:110] for n in (7,)]
    model = secrets.RandomStrings.trained(["hunter2hunter2"], words + [key() for _ in range(planted)])
    assert np.mean([model.accepts(s) for s in fresh]) >= 0.95
    assert np.mean([model.accepts(f"{a}_{b}_{c}_2024") for a in secrets.ORDINARY[:20] for b in secrets.ORDINARY[40:60] for c in ("handler", "module")]) <= 0.01


def test_secrets(docs, empty, spark):
    model = secrets.fit(docs)
    assert len(secrets.found(docs, model).collect()) == len(ROWS)
    assert secrets.found(empty, model).collect() == []
    text = "x ghp_16C7e42F292c6912E7710c838347Ae178B4a get_user_profile_by_account_identifier secret:token:abcdefghijk AKIAABCD Password = 'abcdefgh'"
    got = [(r.kind, text[r.start : r.end]) for r in secrets.found(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).first().spans]
    assert got == [("random", "ghp_16C7e42F292c6912E7710c838347Ae178B4a"), ("assign", "Password = 'abcdefgh")]


def test_secrets_told_from_identifiers(spark, sf):
    """Held-out strings of both classes against models of the small table: recall by alphabet, precision on words without a seed."""
    import random
    import string

    rng = random.Random(5)
    model = secrets.fit(spark.read.parquet(f"{sf}/documents.parquet"))
    lower, upper, digits = string.ascii_lowercase, string.ascii_uppercase, string.digits
    for alphabet in (lower + upper + digits, lower + upper, lower, upper + digits, digits + "abcdef"):
        keys = ["".join(rng.choices(alphabet, k=k)) for k in (20, 24, 32, 40) for _ in range(250)]
        assert np.mean([model.accepts(k) for k in keys]) >= 0.97
    unseen = "anchor bundle carrier deposit economy forest garden harbor island jungle kitchen lantern mirror needle orchard planet quarter rocket shelter tunnel umbrella valley winter yellow".split()
    assert not set(unseen) & set(secrets.ORDINARY)
    names = [join(rng.choices(unseen, k=4)) for join in ("_".join, "-".join, "/".join, lambda p: "".join(w.title() for w in p)) for _ in range(500)]
    names += ["2024-01-31-12-30-59", "0" * 24, "=" * 40, "20240131123059999999", "-_" * 12]
    assert np.mean([model.accepts(n) for n in names]) <= 0.02


def test_secrets_in_linear_time():
    import time

    def took(n):
        began = time.perf_counter()
        assert len(secrets.scan("token=abcdefgh1234 plain_words_in_between_them " * n, secrets_model)) == n
        return time.perf_counter() - began

    secrets_model = secrets.RandomStrings.trained([], [])
    took(2000)
    assert took(40_000) < 4 * max(0.05, min(took(20_000), took(20_000)))


def test_near(docs, empty):
    rows = by_id(minhash.near_duplicates(docs, n_words=2))
    assert rows[1].n_shingles == 0 and rows[1].component_id == 1 and rows[2].component_id == 2
    assert rows[5].component_id == 3 and rows[6].component_id == 3 and not rows[6].kept
    assert rows[8].n_shingles == 1 and rows[None].component_id is None
    assert minhash.near_duplicates(empty).collect() == []


def test_near_groups_larger_than_a_block(spark, monkeypatch):
    """Chains and many rivals in one bucket, searched in several blocks."""
    from brute import near

    monkeypatch.setattr(minhash, "BLOCK", 16)
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for k in range(150):
        words = list(base)
        for _ in range(k % 13):
            words[rng.integers(60)] = f"v{rng.integers(200)}"
        texts.append((k, " ".join(words)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"), n_words=2).collect()}
    assert got == near(texts)


def test_rivals_without_links_are_searched_in_bounded_groups(spark, monkeypatch):
    """One template, similarity of about 0.76: every document is a component of its own and a rival of all others."""
    from brute import near

    rng = np.random.default_rng(6)
    texts = []
    for k in range(150):
        words = [f"w{i}" for i in range(60)]
        for at in rng.choice(30, 2, replace=False):
            words[2 * at] = f"v{k}x{at}"
        texts.append((k, " ".join(words)))
    docs = spark.createDataFrame([*texts, (150, texts[0][1] + " more")], "doc_id long, text string")
    monkeypatch.setattr(minhash, "BLOCK", 16)

    def sizes(bounds, percent):
        def run(batches):
            from collections import Counter

            import pyarrow as pa

            seen = Counter(x for b in batches for x in zip(b.column("main").to_pylist(), b.column("block").to_pylist(), strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(list(seen.values()), pa.int64()), pa.array([0] * len(seen), pa.int64())], names=["a", "b"])

        return run

    with monkeypatch.context() as m:
        m.setattr(minhash, "_search_batches", sizes)
        run = minhash.NearDuplicates(docs, "doc_id", "text", 2, 80)
        none = spark.createDataFrame([], "id long, component long")
        assert max(r.a for r in run.between_components(run.members().drop("hub"), none).collect()) <= 4 * minhash.BLOCK
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs, n_words=2).collect()}
    assert got == near([*texts, (150, texts[0][1] + " more")]) and got[150][1] == 0


def test_templates_below_the_threshold_move_signatures_alone(spark, monkeypatch):
    """5,000 documents of one template that all share buckets and link with nothing: no cell asks for a set, and rows grow as rivals by parts."""
    rng = np.random.default_rng(8)
    texts = []
    for k in range(5000):
        words = [f"w{i}" for i in range(60)]
        for at in rng.choice(29, 8, replace=False):
            words[2 * at] = f"v{k}x{at}"
        texts.append((k, " ".join(words)))
    made = {}
    plain = minhash.written
    monkeypatch.setattr(minhash, "written", lambda df, name: made.setdefault(name, plain(df, name)) if name in ("cells", "asking", "open-sets", "open-ids") else plain(df, name))
    rows = minhash.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"), n_words=2)
    assert rows.where("component_id <> doc_id").count() == 0
    rivals = made["open-ids"].count()
    assert rivals > 4900 and made["asking"].count() == made["open-sets"].count() == 0
    assert made["cells"].count() <= minhash.BANDS * rivals


def test_bounds_lose_no_more_than_promised():
    from math import comb

    bounds = minhash.least_matches()
    assert bounds[-1][0] == minhash.PERMUTATIONS
    for k, m in bounds:  # a pair at the threshold falls below the bound with probability MISS or little more
        assert sum(comb(k, j) * 0.8**j * 0.2 ** (k - j) for j in range(m)) < 3 * minhash.MISS


def test_lines(docs, empty, spark):
    index = lines.LineIndex(spark, min_docs=2).insert(docs)
    got = by_id(index.apply(docs))
    assert got[1].n_lines == 1 and got[1].n_dropped == 0 and got[1].kept_text == ""
    assert got[5].n_dropped == 1 and got[5].kept_text == "" and got[7].n_dropped == 0
    shuffled = index._apply_shuffled(docs.select("doc_id", F.col("text").cast("binary").alias("text")))
    assert sorted(map(repr, shuffled.select("doc_id", "n_lines", "n_dropped", "kept_text").collect())) == sorted(map(repr, index.apply(docs).collect()))
    assert lines.LineIndex(spark).insert(empty).apply(empty).collect() == []


@pytest.mark.parametrize("size", [None, 0])
def test_lines_of_one_long_document(spark, monkeypatch, size):
    """Whatever the filters' size, and though they let wrong lines through: those of the exact table go."""
    if size is not None:
        monkeypatch.setattr(lines, "BROADCAST_BYTES", size)
    monkeypatch.setattr(lines.CuckooFilter, "holds_many", lambda self, digests: np.ones(len(digests), bool))
    monkeypatch.setattr(lines, "SALTS", 3)
    texts = [(i, f"often {i % 7}\nonly {i}\n\n OFTEN {i % 7}") for i in range(100)] + [(100, "\n".join(f"l{i}\noften 3" for i in range(20_000)))]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = by_id(lines.LineIndex(spark, shards=5).insert(docs).apply(docs))
    assert all((got[i].n_lines, got[i].n_dropped, got[i].kept_text) == (4, 2, f"only {i}\n") for i in range(100))
    assert (got[100].n_lines, got[100].n_dropped) == (40_000, 20_000) and got[100].kept_text == "\n".join(f"l{i}" for i in range(20_000))


def test_line_shards_follow_the_keys(spark, monkeypatch):
    monkeypatch.setattr(lines, "SHARD_KEYS", 50)
    monkeypatch.setattr(lines, "LEAST_SHARDS", 2)
    part = lambda a, b: spark.createDataFrame([(d, "\n".join(f"line {k}" for k in range(a, b))) for d in range(10)], "doc_id long, text string")
    first = lines.LineIndex(spark).insert(part(0, 100))
    both = first.insert(part(100, 1000))
    assert (first.shards, both.shards) == (2, 20) and {r.kept_text for r in both.apply(part(0, 1000)).collect()} == {""}
    held = [lines.CuckooFilter.from_bytes(bytes(r.filter)) for r in both.filters.collect()]
    assert sum(int((f.table > 0).sum()) for f in held) == 1000


def test_lines_can_be_taken_back(spark):
    kind = "doc_id long, text string"
    a = spark.createDataFrame([(i, f"common\nonly {i}\nlate" if i < 6 else "common\n  COMMON ") for i in range(12)], kind)
    b = spark.createDataFrame([(100 + i, "late\nfresh") for i in range(6)], kind)
    first = lines.LineIndex(spark).insert(a)
    both = first.insert(b)
    back = both.delete(b)
    state = lambda x: ({(bytes(r.digest), r.n) for r in x.counts.collect()}, {bytes(r.digest) for r in x.dropped_keys().collect()})
    assert state(back) == state(first)
    assert {r.kept_text for r in both.apply(b).collect()} == {"fresh"} and {r.kept_text for r in back.apply(b).collect()} == {"late\nfresh"}
    held = [lines.CuckooFilter.from_bytes(bytes(r.filter)) for r in back.filters.collect()]
    assert sum(int((f.table > 0).sum()) for f in held) == len(state(first)[1])


def test_cuckoo_filter():
    digests = [hashlib.md5(str(i).encode()).digest() for i in range(5000)]
    held = lines.CuckooFilter.of(digests[:4000])
    assert all(held.holds_many(digests[:4000])) and np.mean(held.holds_many(digests[4000:])) < 0.01
    for d in digests[:2000]:
        assert held.delete(d)
    assert all(map(held.holds, digests[2000:4000])) and np.mean(held.holds_many(digests[:2000])) < 0.01


def test_pii(docs, empty, spark):
    assert len(pii.personal_data(docs).collect()) == len(ROWS)
    assert pii.personal_data(empty).collect() == []


def test_pii_discovers_by_context(spark):
    rows = [(i, f"some words here then Ausweis-Nr: {'+49 (30) 5550' + str(100 + i) if i < 12 else 'X7' + str(1000 + i) + 'Q'} and {i} more") for i in range(14)]
    rows += [(50 + i, f"chapter {1000 + i} of the book") for i in range(20)]
    got = {r.doc_id: [s.kind for s in r.spans] for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i] == ["phone"] for i in range(12)) and got[12] == got[13] == ["context"]
    assert all(got[50 + i] == [] for i in range(20))


def test_pii_is_linear_in_long_texts(spark):
    text = "a" * 200_000 + " " + "1 " * 50_000 + "x@" * 1000 + " " + "1.2." * 20_000
    assert len(pii.personal_data(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()) == 1


def test_pii_is_linear_in_spans(spark):
    import time

    def took(n):
        text = " ".join(f"user{i}@mail{i}.example.com" for i in range(n))
        rows = spark.createDataFrame([(1, text)], "doc_id long, text string")
        began = time.perf_counter()
        spans = pii.personal_data(rows).first().spans
        took = time.perf_counter() - began
        assert len(spans) == n and text[spans[-1].start : spans[-1].end] == f"user{n - 1}@mail{n - 1}.example.com"
        return took

    took(100)
    assert took(40_000) < 3 * took(20_000)


def test_pii_contexts(spark):
    """Words beside instances, near and far, next to other instances and torn; identifiers over base spans are no candidates."""
    far = "x" * 300
    texts = ["mail to a@b.c", f"{far} {far} a@b.c", "a@b.c d@e.f g@h.i", "one\t a@b.c", "a@b.c", "(email:a@b.c)", "see 1.2.3.4 5.6.7.8", "a@b.c, is mine now", f"a@b.c {far} {far} end", "a@b.c d@e.f g@h.i j@k.l"]
    rows = pii.searched(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "doc_id", "text")
    got = {r.doc_id: [[p for p in m.patterns if p] for m in r.marks if m.kind != "context"] for r in rows.collect()}
    assert got[0] == [["to", "mail to"]] and got[1] == [[far, f"{far} {far}"]] and got[3] == [["one"]]
    assert got[2] == [[">d@e.f", ">d@e.f g@h.i"], ["a@b.c", ">g@h.i"], ["d@e.f", "a@b.c d@e.f"]] and got[4] == [[]] and got[5] == [["email"]]
    assert got[6] == [["see", ">5.6.7.8"], ["1.2.3.4", "see 1.2.3.4"]]
    assert got[7] == [[">is", ">is mine"]] and got[8] == [[f">{far}", f">{far} {far}"]]
    assert got[9][0] == [">d@e.f", ">d@e.f g@h.i"] and got[9][3] == ["g@h.i", "d@e.f g@h.i"]
    words = " ".join(f"id{10000 + i} 10.0.0.{i % 250}" for i in range(600))
    marks = pii.searched(spark.createDataFrame([(1, words)], "doc_id long, text string"), "doc_id", "text").first().marks
    taken = [(m.start, m.end) for m in marks if m.kind != "context"]
    free = [words[m.start : m.end] for m in marks if m.kind == "context"]
    assert len(taken) == 600 and free == [f"id{10000 + i}" for i in range(600)]


def test_pii_graph_against_brute_force(spark):
    """Context spans of a table: names joined to values, words behind, several hops, sentence ends, patterns too common to count."""
    from brute import contexts

    rng = np.random.default_rng(11)
    number = lambda k: f"K{50_000 + k}Z"
    texts = [f"write, email:u{k}@mail.example or later" for k in range(60)]
    texts += [f"write, email:{number(k)}; or id={number(k)}." for k in range(8)]  # learnt by email, which teach id
    texts += [f"see (id={number(100 + k)}), then {number(200 + k)} holder said" for k in range(1)]  # known by id; then is common
    texts += [f"call {number(k)} holder said no" for k in range(8)] + [f"room {number(300 + k)} holder said. Yes" for k in range(4)]  # behind
    texts += [f"then chapter{1000 + k} and post lists then {''.join(map(str, rng.integers(0, 9, 6)))}" for k in range(12)]
    rows = list(enumerate([*texts, None, "", "email:", f"email:{number(900)}"]))
    got = {r.doc_id: [(s.start, s.end) for s in r.spans if s.kind == "context"] for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = contexts(rows, pii.SUPPORT, pii.CONFIDENT)
    assert got == want and sum(map(len, want.values())) > 20
    assert all(texts[i][a:b].startswith("K") and texts[i][a:b].endswith("Z") for i in range(len(texts)) for a, b in got[i])


def test_vectors(spark):
    nan = float("nan")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.1]), (3, [1.0, 0.0]), (4, None), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [1.0, None]), (8, []), (9, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (10, [0.0, 1.0]), (10, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"v": F.lit(1), "digest": F.lit(2), "label": F.lit(None).cast("int")})
    got = {(r.vec_id, r.n_links, r.component_id, r.kept) for r in embeddings.near_vectors(df).collect()}
    assert {(1, 2, 1, True), (2, 2, 1, False), (3, 2, 1, False), (4, 0, 4, True), (5, 0, 5, True), (6, 0, 6, True), (7, 0, 7, True), (8, 0, 8, True), (9, 0, 9, True), (10, 1, 10, True)} <= got
    assert embeddings.near_vectors(df.where("false")).collect() == []


def test_vector_recall_and_counts(spark):
    from brute import roots

    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 16))
    x = np.concatenate([c + rng.normal(scale=s, size=(30, 16)) for c, s in zip(centres, np.linspace(0.1, 0.6, 40), strict=True)]).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    a, b = np.nonzero(np.triu(u @ u.T >= 0.9, 1))
    want = np.bincount(np.concatenate([a, b]), minlength=len(x))
    found = sum(n for n, _ in got.values())
    assert all(got[i][0] <= want[i] for i in range(len(x))) and found >= 0.9 * want.sum()
    if found == want.sum():
        assert {i: c for i, (_, c) in got.items()} == roots(range(len(x)), zip(a.tolist(), b.tolist(), strict=True))


@pytest.mark.parametrize("rank,coarse", [(2, 4096), (3, 4096), (6, 4096), (64, 4096), (3, 8), (64, 8)])
def test_vector_probes_meet_linked_pairs(rank, coarse):
    """Data of low and of full rank in 64 dimensions with pairs at the threshold, one level of centres and two."""
    rng = np.random.default_rng(rank)
    x = rng.normal(size=(4000, rank)) @ (rng.normal(size=(rank, 64)) if rank < 64 else np.eye(64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    away = rng.normal(size=(500, rank)) @ (np.linalg.pinv(x[:500]) @ x[:500] if rank < 64 else np.eye(64))[:rank]
    away -= (away * x[:500]).sum(1, keepdims=True) * x[:500]
    away /= np.linalg.norm(away, axis=1, keepdims=True)
    x[500:1000] = 0.901 * x[:500] + np.sqrt(1 - 0.901**2) * away
    index = embeddings.ProductIndex.fitted(x, 12_000, 0.9, coarse)
    home, _, _, probes = index.coded(x)
    goes = np.zeros((len(x), index.norms.size), bool)
    for i, lists in enumerate(probes):
        goes[i, [home[i], *lists]] = True
    a, b = np.nonzero(np.triu(x @ x.T >= 0.9, 1))
    assert index.norms.size >= 40 and len(index.coarse) == min(coarse, 46) and len(a) >= 500
    assert np.mean(goes[a, home[b]] | goes[b, home[a]]) >= 0.995
    if rank == 64:
        assert np.mean(goes) < 0.3


def test_vector_recall_at_the_threshold(spark):
    """64 dimensions, 25 lists, every link planted at a cosine of 0.9 to 0.92: the whole operator against brute force."""
    rng = np.random.default_rng(12)
    x = rng.normal(size=(6400, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    other = rng.normal(size=(1500, 64))
    other -= (other * x[:1500]).sum(1, keepdims=True) * x[:1500]
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    cosine = rng.uniform(0.9005, 0.92, size=(1500, 1))
    x[2000:3500] = cosine * x[:1500] + np.sqrt(1 - cosine**2) * other
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = np.array([r.n_links for r in embeddings.near_vectors(df).orderBy("vec_id").collect()])
    want = (x @ x.T >= 0.9).sum(1) - 1
    assert want.sum() >= 3000 and (got <= want).all() and got.sum() >= 0.99 * want.sum()


def test_vectors_of_any_scale(spark):
    rows = [(1, [1e200, 0.0]), (2, [1e200, 1e198]), (3, [5e-324, 0.0]), (4, [1e-300, 1e-302]), (5, [0.0, 1e308])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: (3, 1), 2: (3, 1), 3: (3, 1), 4: (3, 1), 5: (0, 5)}


def test_vector_links_in_blocks_and_parts(spark, monkeypatch):
    from brute import roots

    monkeypatch.setattr(embeddings, "BLOCK", 100)
    monkeypatch.setattr(embeddings, "VISITORS", 150)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(2000, 4)) @ rng.normal(size=(4, 64))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_vectors(df, threshold=0.97).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    a, b = np.nonzero(np.triu(u @ u.T >= 0.97, 1))
    n, part = np.bincount(np.concatenate([a, b]), minlength=len(x)), roots(range(len(x)), zip(a.tolist(), b.tolist(), strict=True))
    assert got == {i: (n[i], part[i]) for i in range(len(x))}


def test_stages(spark, docs, empty, labels, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for frame in (docs, empty):
        kept = frame
        for _, stage in corpus_pipeline.STAGES[:-1]:
            kept = store.written(stage(spark, kept, str(tmp_path)), "stage")
            assert kept.columns == docs.columns
        out = corpus_pipeline.STAGES[-1][1](spark, kept, str(tmp_path)).collect()
        assert bool(out) == (frame is docs)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_texts_stay_in_place_for_ids_beyond_a_broadcast(spark):
    n = 200_000  # beyond BROADCAST_BYTES as a list of ids
    docs = store.written(spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.repeat(F.lit("w "), (F.col("id") % 7).cast("int"))).alias("text"), F.concat(F.lit("s"), F.col("id") % 3).alias("source")), "docs")
    out = corpus_pipeline.mixing_stage(spark, docs, "")
    assert "BroadcastHashJoin" in plan(out) and "SortMergeJoin" not in plan(out)
    taken = mixing.mixed(docs).where("copies > 0").select("doc_id", "copies")
    counts = out.groupBy("doc_id").agg(F.count("*").alias("copies"))
    assert counts.exceptAll(taken).count() == taken.exceptAll(counts).count() == 0
    assert out.agg(F.sum("doc_id"), F.count("text")).first() == taken.agg(F.sum(F.col("doc_id") * F.col("copies")), F.sum("copies")).first()
    out = corpus_pipeline.without(docs, docs.where("doc_id % 5 > 0"))
    assert "BroadcastHashJoin" in plan(out) and "SortMergeJoin" not in plan(out)
    assert out.agg(F.count("*"), F.min(F.col("doc_id") % 5), F.max(F.col("doc_id") % 5)).first() == (n // 5, 0, 0)


@pytest.mark.parametrize("kind", ["long", "int", "string"])
def test_ids_as_bitmaps(spark, monkeypatch, kind):
    edges = [0, 1, -1, 7, 8, 32767, 32768, 32769, -32767, -32768, -32769, 2**31 - 1, -(2**31)] + [2**63 - 1, -(2**63)] * (kind == "long")
    values = sorted({v + k for v in edges for k in (-1, 0, 1) if abs(v) < 2**20} | set(edges))
    cast = str if kind == "string" else int
    docs = spark.createDataFrame([(cast(v), i) for i, v in enumerate(values)] + [(cast(7), -1), (None, -2)], f"doc_id {kind}, bits int")
    chosen = store.written(spark.createDataFrame([(cast(v), i % 2 + 1) for i, v in enumerate(values) if i % 3] + [(None, 1)], f"doc_id {kind}, n int"), "chosen")
    take = {cast(v): i % 2 + 1 for i, v in enumerate(values) if i % 3}
    rows = [tuple(r) for r in docs.collect()]
    monkeypatch.setattr(store, "small_enough", lambda df: False)
    assert (store.bitmaps(chosen, "doc_id") is None) == (kind == "string")
    for limit in (store.BROADCAST_BYTES, 1):
        monkeypatch.setattr(store, "BROADCAST_BYTES", limit)
        got = lambda how: sorted(map(tuple, store.join_ids(docs, chosen, "doc_id", how).collect()), key=str)  # noqa: B023, E731
        assert got("inner") == sorted([(*r, take[r[0]]) for r in rows if r[0] in take], key=str)
        assert got("left_semi") == sorted([r for r in rows if r[0] in take], key=str)
        assert got("left_anti") == sorted([r for r in rows if r[0] not in take], key=str)
    assert store.bitmaps(chosen, "doc_id") is None


def test_shared_tables_are_released(spark):
    import os

    df = store.written(spark.range(3).toDF("id"), "probe")
    path = next(p for s, p in store._written if "probe" in p)
    assert df.count() == 3 and os.path.exists(path.removeprefix("file://"))
    store.release(spark)
    assert not os.path.exists(path.removeprefix("file://"))
