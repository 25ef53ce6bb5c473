"""Quality by attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE words. A passage is encoded by the forms of its
words (case, digits, the signs at the end, length; hashed to BUCKETS shares) and by
figures of its bytes and repetitions; labels are known of documents only. A gated
attention network is learnt from them:

    h_k = tanh(W x_k + b)           encoding of passage k
    a_k = softmax_k(u . (tanh(V h_k) * sigmoid(U h_k)))
    score = sigmoid(c . sum_k a_k h_k + d)

so the document is scored by its weighted passage, and a bad passage among good ones
can decide where a mean would hide it. Training reads at most SAMPLE labelled rows of
each class, those with the smallest hash of the id, one for an id, of texts of at
most LEARNT_BYTES bytes; never a row kept for the test. Whole texts are scored, in one pass and
without a shuffle, in pieces of PIECE bytes cut between words (repetitions are looked
for within a piece).

Defined cases: null text counts as empty, and an empty text is one passage without
words; labels that are null or lack a document are not used; without rows of both classes
nothing is learnt and every score is one half (0 without class 1), so nothing is
predicted; rows that repeat a doc_id score alike; an empty table gives no rows;
columns other than id and text are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.store import small_batches, trim_memory

SAMPLE, LEARNT_BYTES, THRESHOLD = 3000, 1 << 20, 0.7
PASSAGE, BUCKETS, PIECE, KINDS = 48, 96, 1 << 20, 5
HIDDEN, GATES, EPOCHS, BATCH, RATE, SHRINK, SEED = 24, 12, 40, 64, 0.01, 0.01, 11
FIGURES, FAR = 11, 4
WIDTH = BUCKETS + FIGURES
SPACE, LOWER, UPPER, DIGIT, SIGN = range(KINDS)


def _kinds() -> np.ndarray:
    """The kind of each byte; bytes of letters beyond ASCII count as lower case."""
    kind = np.full(256, SIGN, np.uint8)
    kind[list(b" \t\n\v\f\r")] = SPACE
    kind[list(range(ord("a"), ord("z") + 1)) + list(range(128, 256))] = LOWER
    kind[ord("A") : ord("Z") + 1] = UPPER
    kind[ord("0") : ord("9") + 1] = DIGIT
    return kind


KIND = _kinds()
BYTE = np.random.default_rng(SEED).integers(1, 1 << 62, 256, np.uint64)
MIX = np.uint64(0x9E3779B97F4A7C15)


def held_out(id_col: str):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2


def cut(text: bytes) -> list[bytes]:
    """Pieces of at most PIECE bytes, cut at a blank where there is one."""
    out, at = [], 0
    while len(text) - at > PIECE:
        end = max(text.rfind(b" ", at, at + PIECE), text.rfind(b"\n", at, at + PIECE))
        end = end if end > at else at + PIECE
        out.append(text[at:end])
        at = end
    return [*out, text[at:]]


def passages(text: bytes) -> np.ndarray:
    """The features of each passage of a piece, one row each; one row of zeros without words."""
    if not text.split(None, 1):
        return np.zeros((1, WIDTH), np.float32)
    data = np.frombuffer(text, np.uint8)
    kind = KIND[data]
    word = kind != SPACE
    edge = np.diff(np.concatenate([[False], word, [False]]).astype(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    n = len(start)
    size = end - start
    of = np.stack([np.add.reduceat(kind == k, start, dtype=np.int64) for k in (LOWER, UPPER, DIGIT, SIGN)], 1)  # blanks between words count nowhere
    place = np.arange(len(data)) - np.repeat(np.append(0, start), np.diff(np.concatenate([[0], start, [len(data)]])))
    with np.errstate(over="ignore"):
        name = np.add.reduceat(np.where(word, BYTE[data] * (place.astype(np.uint64) * MIX | np.uint64(1)), np.uint64(0)), start)
        tail = data[end - 1].astype(np.int64)
        tail[kind[end - 1] != SIGN] = 0
        signs = np.minimum(of[:, 3], 4)
        form = tail * 64 + signs * 12 + (of[:, 1] > 0) * 6 + (of[:, 1] == size - of[:, 3]) * 3 + np.minimum(of[:, 2], 2)
        form = form * 8 + np.minimum(size - of[:, 3], 28) // 4
        bucket = ((form.astype(np.uint64) * MIX) >> np.uint64(33)).astype(np.int64) % BUCKETS
        pair = name[:-1] * MIX ^ name[1:]
    part = np.arange(n) // PASSAGE
    parts = int(part[-1]) + 1
    count = np.bincount(part, minlength=parts).astype(np.float64)
    share = lambda flags: np.bincount(part, flags, parts) / count
    order = np.lexsort((name, part))
    distinct = np.bincount(part[order][np.concatenate([[True], (np.diff(part[order]) != 0) | (name[order][1:] != name[order][:-1])])], minlength=parts) / count
    again = np.ones(n, bool)
    again[:-1][np.unique(pair, return_index=True)[1]] = False
    again[-1] = False
    lines = np.add.reduceat(data == 10, np.concatenate([[0], start[PASSAGE::PASSAGE]]), dtype=np.int64) / count
    letters = np.maximum(np.bincount(part, size, parts), 1)
    out = np.zeros((parts, WIDTH), np.float32)
    out[:, :BUCKETS] = np.sqrt(np.bincount(part * BUCKETS + bucket, minlength=parts * BUCKETS).reshape(parts, BUCKETS) / count[:, None])
    out[:, BUCKETS:] = np.stack(
        [
            *(np.bincount(part, of[:, k], parts) / letters for k in (1, 2, 3)),
            share(size) / 10,
            share(of[:, 3] == size),
            share(of[:, 3] > 0),
            share(of[:, 1] == size - of[:, 3]),
            share(np.concatenate([[False], name[1:] == name[:-1]])),
            distinct,
            share(again),
            np.minimum(lines, 2),
        ],
        1,
    )
    return out


def bag(text: bytes) -> np.ndarray:
    """The passages of a whole text."""
    return np.concatenate([passages(piece) for piece in cut(text)])


class AttentionModel:
    """Weights by name, and mean and spread of the features, which count as FAR spreads from the mean at most."""

    def __init__(self, weights: dict[str, np.ndarray], mean: np.ndarray, spread: np.ndarray):
        self.weights, self.mean, self.spread = weights, mean, spread

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.spread, -FAR, FAR)

    @classmethod
    def constant(cls, score: float) -> AttentionModel:
        sizes = {"W": (WIDTH, 1), "b": (1,), "V": (1, 1), "U": (1, 1), "u": (1,), "c": (1,)}
        with np.errstate(divide="ignore"):
            return cls({k: np.zeros(s) for k, s in sizes.items()} | {"d": np.log(np.array(score) / (1 - score))}, np.zeros(WIDTH), np.ones(WIDTH))

    def forward(self, x: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
        """x: standardised passages of several bags, one after the other; starts: where each begins."""
        w, sizes = self.weights, np.diff(np.append(starts, len(x)))
        h = np.tanh(x @ w["W"] + w["b"])
        t, g = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-(h @ w["U"])))
        raw = (t * g) @ w["u"]
        raw = np.exp(raw - np.repeat(np.maximum.reduceat(raw, starts), sizes))
        a = raw / np.repeat(np.add.reduceat(raw, starts), sizes)
        z = np.add.reduceat(a[:, None] * h, starts)
        return {"h": h, "t": t, "g": g, "a": a, "z": z, "margin": z @ w["c"] + w["d"]}

    def slopes(self, x: np.ndarray, starts: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Derivatives of the mean log loss."""
        w, at, sizes = self.weights, self.forward(x, starts), np.diff(np.append(starts, len(x)))
        out = (1 / (1 + np.exp(-at["margin"])) - y) / len(y)
        of_z = np.repeat(out[:, None] * w["c"], sizes, 0)
        of_a = (of_z * at["h"]).sum(1)
        of_raw = at["a"] * (of_a - np.repeat(np.add.reduceat(at["a"] * of_a, starts), sizes))
        of_t, of_g = of_raw[:, None] * w["u"] * at["g"], of_raw[:, None] * w["u"] * at["t"]
        of_v, of_u = of_t * (1 - at["t"] ** 2), of_g * at["g"] * (1 - at["g"])
        of_h = at["a"][:, None] * of_z + of_v @ w["V"].T + of_u @ w["U"].T
        of_w = of_h * (1 - at["h"] ** 2)
        return {"W": x.T @ of_w, "b": of_w.sum(0), "V": at["h"].T @ of_v, "U": at["h"].T @ of_u, "u": (at["t"] * at["g"]).T @ of_raw, "c": at["z"].T @ out, "d": out.sum()}

    @classmethod
    def fitted(cls, bags: list[np.ndarray], y: np.ndarray, seed: int = SEED) -> AttentionModel:
        if not (y == 1).any() or not (y == 0).any():
            return cls.constant(0.5 if (y == 1).any() else 0.0)
        rng = np.random.default_rng(seed)
        every = np.concatenate(bags)
        mean, spread = every.mean(0, np.float64), np.maximum(every.std(0, dtype=np.float64), 0.02)
        shapes = {"W": (WIDTH, HIDDEN), "b": (HIDDEN,), "V": (HIDDEN, GATES), "U": (HIDDEN, GATES), "u": (GATES,), "c": (HIDDEN,), "d": ()}
        model = cls({k: rng.normal(0, 1 / np.sqrt(s[0]), s) if s else np.zeros(()) for k, s in shapes.items()}, mean, spread)
        scaled = [model.scaled(b).astype(np.float32) for b in bags]
        first, second, step = {k: np.zeros(s) for k, s in shapes.items()}, {k: np.zeros(s) for k, s in shapes.items()}, 0
        for _ in range(EPOCHS):
            for rows in np.array_split(rng.permutation(len(scaled)), max(1, len(scaled) // BATCH)):
                sizes = np.array([len(scaled[i]) for i in rows])
                slopes = model.slopes(np.concatenate([scaled[i] for i in rows]), np.cumsum(sizes) - sizes, y[rows])
                step += 1
                for k, slope in slopes.items():
                    slope = slope + SHRINK * model.weights[k]
                    first[k] = 0.9 * first[k] + 0.1 * slope
                    second[k] = 0.999 * second[k] + 0.001 * slope**2
                    model.weights[k] = model.weights[k] - RATE * first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
        return model

    def scores(self, bags: list[np.ndarray]) -> np.ndarray:
        if not bags:
            return np.zeros(0)
        sizes = np.array([len(b) for b in bags])
        x = self.scaled(np.concatenate(bags))
        with np.errstate(over="ignore"):
            return 1 / (1 + np.exp(-self.forward(x, np.cumsum(sizes) - sizes)["margin"]))


def _bag_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bags = [bag(text.as_py() or b"").tobytes() for text in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bags, pa.binary())], names=["y", "bag"])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> AttentionModel:
    """Trained on at most `sample` labelled rows of each class that are not held out."""
    known = labels.select(F.col("doc_id").alias("label_id"), F.col("quality").cast("int").alias("y")).where(F.col("label_id").isNotNull() & F.col("y").isin(0, 1)).where(~held_out("label_id"))
    known = known.groupBy("label_id").agg(F.min("y").alias("y"))  # a label that contradicts itself counts as 0
    order = F.md5(F.col("label_id").cast("string"))
    taken = known.where("y = 1").orderBy(order).limit(sample).unionAll(known.where("y = 0").orderBy(order).limit(sample))  # at most 2 * sample rows
    texts = docs.select(F.col(id_col).alias("label_id"), F.col(text_col).cast("string").cast("binary").alias("text")).where(F.coalesce(F.length("text"), F.lit(0)) <= LEARNT_BYTES)
    texts = texts.join(F.broadcast(taken), "label_id").groupBy("label_id").agg(F.first("y").alias("y"), F.min("text").alias("text"))  # one row an id
    rows = small_batches(texts.select("y", "text")).mapInArrow(_bag_batches, "y int, bag binary").toArrow()  # at most 2 * sample rows of bounded texts
    bags, y = rows["bag"].to_pylist(), rows["y"].to_numpy()
    order = sorted(range(len(bags)), key=lambda i: (y[i], bags[i]))
    return AttentionModel.fitted([np.frombuffer(bags[i], np.float32).reshape(-1, WIDTH) for i in order], y[order])


def _score_batches(model: AttentionModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = np.concatenate([np.zeros(0), *(model.scores([bag(text.as_py() or b"") for text in batch.column(1).slice(at, 64)]) for at in range(0, batch.num_rows, 64))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])
            batch = None
            trim_memory()

    return run


def scored(docs: DataFrame, model: AttentionModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, predicted of every document."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    out = small_batches(rows).mapInArrow(_score_batches(model), f"doc_id {kind}, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def query(spark, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return scored(docs, fit(docs, labels)).select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "score", "predicted")
