"""The queries over whole tables against brute force."""

import numpy as np
import pytest
from brute import joined, near, personal, roots, secrets, sha
from pyspark.sql import functions as F

from palisade.llm import queries


@pytest.fixture(scope="module")
def docs(spark, sf):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}


def test_embeddings_against_all_pairs(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    x = np.array([r.embedding for r in rows], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = [r.vec_id for r in rows]
    a, b = np.nonzero(np.triu(x @ x.T >= 0.9, 1))
    n = np.bincount(np.concatenate([a, b]), minlength=len(ids))
    comp = roots(ids, [(ids[i], ids[j]) for i, j in zip(a, b, strict=True)])
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in queries.QUERIES["op2_embedding_near_dedup"](spark, sf).collect()}
    assert got == {v: (n[i], comp[v], comp[v] == v) for i, v in enumerate(ids)}


def test_bpe_like_tiktoken(spark, sf, docs):
    import public_tokenizers as P
    import tiktoken

    from palisade.llm.bpe import load_ranks

    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=load_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    for r in queries.QUERIES["op4_byte_bpe"](spark, sf).collect():
        ids = own.encode_ordinary(docs[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(np.array(ids, "<u4").tobytes()), sha(docs[r.doc_id] or ""))


def test_toxicity_on_held_out_rows(spark, sf):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in queries.QUERIES["op5_toxicity"](spark, sf).collect() if r.held_out and labels.get(r.doc_id) is not None]
    right = np.mean([r.predicted == labels[r.doc_id] for r in rows])
    assert right >= 0.95, right  # a few documents here carry the label of a text that was overwritten by junk
    assert not any(r.predicted for r in rows if labels[r.doc_id] == 0)
    assert all(0 <= r.score <= 1 for r in rows)


def test_secrets_base_and_more(spark, sf, docs):
    for r in queries.QUERIES["op7_secret_scan"](spark, sf).collect():
        base = secrets(docs[r.doc_id])
        assert r.base_sha256 == sha(joined(base))
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(s[0] == k for s in base) for k in ("assign", "access", "hex")]
        assert set(joined(base).split(",")) <= set(r.spans.split(",")) | {""}


def test_near_duplicates_against_all_pairs(spark, sf, docs):
    want = near(docs.items())
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.QUERIES["op8_minhash_near_dedup"](spark, sf).collect()}
    assert got == want


def test_personal_data_base(spark, sf, docs):
    for r in queries.QUERIES["op10_pii"](spark, sf).collect():
        base = personal(docs[r.doc_id])
        assert r.base_sha256 == sha(joined(base))
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in base) for k in ("email", "ip", "card", "phone")]
        assert set(joined(base).split(",")) <= set(r.spans.split(",")) | {""}


def test_pipeline_stages(spark, sf, docs):
    """Every stage's decisions against brute force over what its predecessor kept."""
    import re

    import corpus_pipeline
    from palisade.llm import mixing, store, toxicity

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "minhash_near_dedup", "mixing", "byte_bpe"]
    table = spark.read.parquet(f"{sf}/documents.parquet")
    kept, frame = [set(docs)], table
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frame = store.written(stage(spark, frame, sf), name)
        assert frame.columns == table.columns
        ids = [r.doc_id for r in frame.select("doc_id").collect()]
        kept.append(set(ids))
    start, clean, exact, near_kept, mixed = kept
    model = toxicity.fit(table, spark.read.parquet(f"{sf}/labels.parquet"))
    at = {int(t): i for i, t in enumerate(model.terms)}

    def toxic(text):
        words = set(toxicity.WORD.findall((text or "").lower()))
        rows = sorted({at[t] for w in words for t in toxicity.terms_of(w) if t in at})
        margin = model.bias + sum(model.weights[i] for i in rows) + sum(float(model.factors[i] @ model.factors[j]) for k, i in enumerate(rows) for j in rows[k + 1 :])
        return 1 / (1 + np.exp(-margin)) >= toxicity.THRESHOLD

    assert clean == {i for i in start if not toxic(docs[i])}
    first = {}
    for i in sorted(clean):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", docs[i] or ""), i)
    assert exact == set(first.values())
    assert near_kept == {i for i, (_, c) in near([(i, docs[i]) for i in exact], 5).items() if c == i}
    taken = {r.doc_id: r.copies for r in mixing.mixed(table.where(F.col("doc_id").isin(sorted(near_kept)))).collect()}
    assert mixed == {i for i, n in taken.items() if n} and {i: ids.count(i) for i in mixed} == {i: n for i, n in taken.items() if n}
    out = queries.QUERIES["pipeline"](spark, sf).collect()
    assert sorted(r.doc_id for r in out) == sorted(ids) and all(r.decoded_sha256 == sha(docs[r.doc_id] or "") for r in out)
