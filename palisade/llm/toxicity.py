"""Toxicity by a factorization machine over hashed terms.

The terms of a document are its lower-cased words and their first four and
five letters, each known by a hash of 32 bits. Terms whose rate differs between
the classes of the training sample (LIFT times or more, and by a likelihood ratio
beyond what the largest of so many terms reaches by chance) enter the model, and so do
terms whose rate differs in that way among the rows that hold one of the STRONG
strongest, however common they are elsewhere:

    score = sigmoid(b + sum w_i + sum_{i<j} <v_i, v_j>)   over present terms i, j

so a pair such as an insult with the mention of a group weighs other than its
parts. Training reads at most SAMPLE labelled rows of each class, those with
the smallest hash of the id, one for an id, and of a row at most LEARNT_TERMS terms, those with the
smallest hash; never a row kept for the test. Of rows of a class whose terms are near copies (an
estimate of their similarity by HASHES minimum hashes is ALIKE or more) one is learnt
from, or the words of a text copied often would pass for signs of its class. The model is as
large as its terms (at most MOST_TERMS) and goes out with the scoring function.
Whole texts are scored, in one pass and without a shuffle.

Defined cases: null text counts as empty and scores the bias alone, like a text
without known terms; labels that are null or lack a document are not used;
without rows of both classes nothing is learnt and every score is one half (0
without class 1), so nothing is predicted; rows that repeat a doc_id score alike; an empty table gives no rows;
columns other than id and text are never read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.store import small_batches, trim_memory

SAMPLE, MOST_TERMS, GAIN, LIFT, LEAST_ROWS, THRESHOLD, KEPT_WORDS = 3000, 4096, 2.0, 2.0, 3, 0.7, 40_000
LEARNT_TERMS, STRONG, HASHES, BANDS, ALIKE = 4000, 64, 64, 16, 0.8
FACTORS, EPOCHS, BATCH, RATE, SHRINK, SEED = 4, 60, 100, 0.2, 2e-5, 7
WORD = re.compile(r"\w+")


def terms_of(word: str) -> list[int]:
    named = {word} | {f"{word[:n]}\x01" for n in (4, 5) if len(word) >= n}
    return [xxhash.xxh32_intdigest(t.encode(errors="surrogatepass")) for t in named]


def held_out(id_col: str):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1


def _term_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text in batch.column(1):
            words = set(WORD.findall((text.as_py() or "").lower()))
            rows.append(np.array(sorted({t for w in words for t in terms_of(w)})[:LEARNT_TERMS], "<u4").tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], names=["y", "terms"])


def _contrast(has1: np.ndarray, has0: np.ndarray, n1: float, n0: float) -> tuple[np.ndarray, np.ndarray]:
    """Twice the log-likelihood ratio of two rates against one, and the log of the rates' ratio, of each term."""
    with np.errstate(divide="ignore", invalid="ignore"):
        parts = [np.where(h > 0, h * np.log(h * (n1 + n0) / ((has1 + has0) * n)), 0) for h, n in ((has1, n1), (has0, n0))]
    return 2 * (parts[0] + parts[1]), np.abs(np.log(((has1 + 0.5) / n1) / ((has0 + 0.5) / n0)))


def without_copies(docs: list[np.ndarray], y: np.ndarray, seed: int) -> list[int]:
    """The rows to learn from: of near copies in a class the first."""
    rng = np.random.default_rng(seed)
    odd, plus = rng.integers(0, 1 << 62, HASHES, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 62, HASHES, np.uint64)
    kept: list[int] = []
    signatures, buckets = [], {}
    for i, d in enumerate(docs):
        if not len(d):
            sign = np.zeros(HASHES, np.uint32)
        else:
            sign = np.min([((d[at : at + 512, None].astype(np.uint64) * odd + plus) >> np.uint64(32)).min(0) for at in range(0, len(d), 512)], 0)
        keys = [(int(y[i]), k, part.tobytes()) for k, part in enumerate(np.split(sign, BANDS))]
        near = {j for key in keys for j in buckets.get(key, ())}
        if any((signatures[j] == sign).mean() >= ALIKE for j in near):
            continue
        for key in keys:
            buckets.setdefault(key, []).append(len(kept))
        kept.append(i)
        signatures.append(sign)
    return kept


class FactorizationMachine:
    """bias, weight and factors over a sorted array of terms."""

    def __init__(self, terms: np.ndarray, bias: float, weights: np.ndarray, factors: np.ndarray):
        self.terms, self.bias, self.weights, self.factors = terms, bias, weights, factors

    def margin(self, rows: list[int]) -> float:
        if not rows:
            return self.bias
        v = self.factors[rows]
        total = v.sum(0)
        return float(self.bias + self.weights[rows].sum() + 0.5 * (total @ total - (v * v).sum()))

    @classmethod
    def fitted(cls, docs: list[np.ndarray], y: np.ndarray, seed: int = SEED) -> FactorizationMachine:
        """docs: the hashed terms of each row, sorted and distinct; y: 0 or 1."""
        alone = without_copies(docs, y, seed)
        docs, y = [docs[i] for i in alone], y[alone]
        n1, n0 = float((y == 1).sum()), float((y == 0).sum())
        if not n1 or not n0:
            return cls(np.zeros(0, np.int64), 0.0 if n1 else float("-inf"), np.zeros(0), np.zeros((0, FACTORS)))
        lengths = np.array([len(d) for d in docs])
        terms, where = np.unique(np.concatenate(docs) if lengths.sum() else np.zeros(0, np.int64), return_inverse=True)
        doc = np.repeat(np.arange(len(docs)), lengths)
        label = y[doc]
        has1, has0 = np.bincount(where[label == 1], minlength=len(terms)), np.bincount(where[label == 0], minlength=len(terms))
        common = has1 + has0 >= LEAST_ROWS
        gain, lift = _contrast(has1, has0, n1, n0)
        gain[~common | (lift < np.log(LIFT)) | (gain < 2 * np.log(max(2, common.sum())) + GAIN)] = 0
        for s in np.argsort(-gain, kind="stable")[:STRONG]:
            if gain[s] <= 0:
                break
            beside = np.zeros(len(docs), bool)  # rows that hold the strong term
            beside[doc[where == s]] = True
            m1, m0 = float(beside[y == 1].sum()), float(beside[y == 0].sum())
            if not m1 or not m0:
                continue
            here = beside[doc]
            with1, with0 = np.bincount(where[here & (label == 1)], minlength=len(terms)), np.bincount(where[here & (label == 0)], minlength=len(terms))
            more, apart = _contrast(with1, with0, m1, m0)
            more[(with1 + with0 < LEAST_ROWS) | (apart < np.log(LIFT)) | (more < 2 * np.log(max(2, common.sum() * STRONG)) + GAIN)] = 0
            gain = np.maximum(gain, more)
        chosen = np.sort(np.argsort(-gain, kind="stable")[:MOST_TERMS])
        chosen = chosen[gain[chosen] > 0]
        local = np.full(len(terms), -1)
        local[chosen] = np.arange(len(chosen))
        rows = [r[r >= 0] for r in np.split(local[where], np.cumsum(lengths)[:-1])]
        return cls(terms[chosen], *cls._trained(rows, y, len(chosen), seed))

    @staticmethod
    def _trained(rows: list[np.ndarray], y: np.ndarray, n: int, seed: int) -> tuple[float, np.ndarray, np.ndarray]:
        """Adagrad on the log loss; row n of the parameters is the bias, present everywhere, and has no factors.

        Each time, a row shows a random part of its terms, so that a term which mostly
        comes with others still carries weight alone.
        """

        def part_of(row: np.ndarray) -> np.ndarray:
            shown = row[rng.random(len(row)) < rng.random()]
            return shown if len(shown) or not len(row) else row[rng.integers(len(row), size=1)]

        rng = np.random.default_rng(seed)
        w, v = np.zeros(n + 1), rng.normal(0, 0.01, (n + 1, FACTORS))
        v[n] = 0
        gw, gv = np.full(n + 1, 1e-6), np.full((n + 1, FACTORS), 1e-6)
        for _ in range(EPOCHS):
            for part in np.array_split(rng.permutation(len(rows)), max(1, len(rows) // BATCH)):
                shown = [np.append(part_of(rows[i]), n) for i in part]
                at, size = np.concatenate(shown), np.array([len(r) for r in shown])
                starts = np.cumsum(size) - size
                doc = np.repeat(np.arange(len(part)), size)
                here = v[at]
                total = np.add.reduceat(here, starts)
                margin = np.add.reduceat(w[at], starts) + 0.5 * ((total**2).sum(1) - np.add.reduceat((here**2).sum(1), starts))
                slope = 1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y[part]
                dw = np.bincount(at, slope[doc], n + 1) / len(part) + SHRINK * w
                each = slope[doc][:, None] * (total[doc] - here)
                dv = np.stack([np.bincount(at, each[:, k], n + 1) for k in range(FACTORS)], 1) / len(part) + SHRINK * v
                dv[n] = 0
                gw += dw * dw
                gv += dv * dv
                w -= RATE * dw / np.sqrt(gw)
                v -= RATE * dv / np.sqrt(gv)
        return float(w[n]), w[:n], v[:n]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> FactorizationMachine:
    """Trained on at most `sample` labelled rows of each class that are not held out."""
    known = labels.select(F.col("doc_id").alias("label_id"), F.col("toxic").cast("int").alias("y")).where(F.col("label_id").isNotNull() & F.col("y").isin(0, 1)).where(~held_out("label_id"))
    known = known.groupBy("label_id").agg(F.max("y").alias("y"))  # a label that contradicts itself counts as 1
    order = F.md5(F.col("label_id").cast("string"))
    taken = known.where("y = 1").orderBy(order).limit(sample).unionAll(known.where("y = 0").orderBy(order).limit(sample))  # at most 2 * sample rows
    texts = docs.select(F.col(id_col).alias("label_id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(taken), "label_id")
    texts = texts.groupBy("label_id").agg(F.first("y").alias("y"), F.min("text").alias("text"))  # one row an id, combined before the shuffle
    rows = texts.select("y", "text").mapInArrow(_term_batches, "y int, terms binary").toArrow()  # at most 2 * sample rows of LEARNT_TERMS terms
    y, docs = rows["y"].to_numpy(), [np.frombuffer(x.as_buffer(), "<u4").astype(np.int64) for x in rows["terms"]]
    order = sorted(range(len(docs)), key=lambda i: (y[i], len(docs[i]), docs[i][:8].tolist()))
    return FactorizationMachine.fitted([docs[i] for i in order], y[order])


def _score_batches(model: FactorizationMachine):
    index = {int(t): i for i, t in enumerate(model.terms)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[int, ...]] = {}
        for batch in batches:
            margins = []
            for text in batch.column(1):
                rows: set[int] = set()
                for word in set(WORD.findall((text.as_py() or "").lower())):
                    found = known.get(word)
                    if found is None:
                        if len(known) >= KEPT_WORDS:
                            known.clear()
                        found = known[word] = tuple(index[t] for t in terms_of(word) if t in index)
                    if found:
                        rows.update(found)
                margins.append(model.margin(sorted(rows)))
            with np.errstate(over="ignore"):
                scores = 1 / (1 + np.exp(-np.array(margins)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])
            batch = None
            trim_memory()

    return run


def scored(docs: DataFrame, model: FactorizationMachine, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, predicted of every document."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    out = small_batches(rows).mapInArrow(_score_batches(model), f"doc_id {kind}, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def query(spark, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return scored(docs, fit(docs, labels)).select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "score", "predicted")
