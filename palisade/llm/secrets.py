r"""Secret scans: fixed shapes, and Markov models of characters for all others.

Three kinds have fixed shapes (assign, access, hex). A fourth, random, is found
by two second-order Markov models of characters, one of random strings and one
of ordinary identifiers: a run of CANDIDATE characters outside the other spans
is reported when its mean log-likelihood ratio exceeds the threshold.

Both models are trained from labelled samples: the values in base spans and
seeded random strings on one side; other words of the sampled documents and
identifiers joined from ordinary words on the other. The sample is bounded
(SAMPLE_DOCS documents with the smallest hash of the id, SAMPLE_VALUES values a
class). Documents also hold secrets that nobody labelled: a first pair of models,
whose ordinary side is seeded alone, keeps their words that look random out of
the ordinary class. The threshold is the score that a share FALSE_ALARMS of the
ordinary strings held back exceeds, or, where higher, that a share MISSED of
the shortest random strings held back falls below.
The models are of one size and go out with the scanning function; whole texts
are scanned, in one pass and without a shuffle.

Spans are (kind, start, end) in code points, end exclusive, each a whole match.

Defined cases: null text counts as empty and has no spans; rows that repeat a
doc_id repeat their spans; texts of any length are scanned whole, in linear
time; without any documents the models rest on the built-in samples; an empty
table gives no rows; columns other than id and text are not read.
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE_DOCS, SAMPLE_VALUES, SEED, LEAST, MARGIN, PSEUDO, FALSE_ALARMS, MISSED = 1000, 4000, 11, 20, 0.15, 0.2, 0.001, 0.01
KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGN_HINTS = ("passw", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")  # what begins later in a run that is too short is shorter still
HEX = re.compile(r"[0-9a-f]{32,}")  # runs are taken whole, so a run too short fails whole
CANDIDATE = re.compile(rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{LEAST},}}")
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-."
SIGMA = len(ALPHABET) + 1
CODE = np.full(128, SIGMA - 1)
CODE[[ord(c) for c in ALPHABET]] = range(SIGMA - 1)
#: Ordinary identifiers are joined from these.
ORDINARY = (
    "account active address album amount array author batch block branch buffer button cache channel client cluster column command config content context "
    "count customer data default device directory document domain driver element engine entry error event export field file filter folder format function "
    "group handler header history image import index input instance item journal label language layer length level library license line list local lock "
    "manager master message method model module monitor name network node number object offset option order output package page parent partition path "
    "pattern payment plugin point policy port process product profile project query queue reader record region release request resource response result "
    "role route rule schema score search section sensor server service session setting shape size source stage state status storage stream string system "
    "table target task template thread time title token total track transfer type update upload user value version view warehouse window worker writer"
).split()


def base_spans(text: str) -> list[tuple[str, int, int]]:
    spans = []
    low = text.lower()
    if any(h in low for h in ASSIGN_HINTS):
        spans += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        spans += [("access", *m.span()) for m in ACCESS.finditer(text)]
    if any(len(w) >= LEAST for w in text.split()):
        spans += [("hex", *m.span()) for m in HEX.finditer(text)]
    return spans


def codes(s: str) -> np.ndarray:
    raw = np.frombuffer(s.encode("ascii", "replace"), np.uint8)
    return CODE[np.minimum(raw, 127)]


class CharMarkov:
    """log2 P(c | two characters before), additive smoothing towards order 1 and 0."""

    def __init__(self, samples: list[str]):
        tri, bi, uni = np.zeros((SIGMA,) * 3), np.zeros((SIGMA,) * 2), np.ones(SIGMA) * PSEUDO
        for s in samples:
            c = codes(s)
            np.add.at(tri, (c[:-2], c[1:-1], c[2:]), 1)
            np.add.at(bi, (c[:-1], c[1:]), 1)
            np.add.at(uni, c, 1)
        p1 = uni / uni.sum()
        p2 = (bi + 10 * PSEUDO * p1) / (bi.sum(1, keepdims=True) + 10 * PSEUDO)
        self.logp = np.log2((tri + 10 * PSEUDO * p2) / (tri.sum(2, keepdims=True) + 10 * PSEUDO)).astype(np.float32)


class RandomStrings:
    """The log-likelihood ratio of the two models and the threshold for its mean."""

    def __init__(self, ratio: np.ndarray, threshold: float):
        self.ratio, self.threshold = ratio, threshold

    def mean(self, s: str) -> float:
        c = codes(s)
        return float(self.ratio[c[:-2], c[1:-1], c[2:]].mean()) if len(c) > 2 else -math.inf

    def accepts(self, s: str) -> bool:
        return self.mean(s) > self.threshold

    @classmethod
    def between(cls, secret: list[str], ordinary: list[str], held_back: list[str], random_back: list[str]) -> RandomStrings:
        """Models of both classes; of the strings held back only those long enough to be reported count for the threshold."""
        made = cls(CharMarkov(secret).logp - CharMarkov(ordinary).logp, 0.0)
        seen = [made.mean(s) for s in held_back if len(s) >= LEAST]
        if seen:
            made.threshold = max(0.0, float(np.quantile(seen, 1 - FALSE_ALARMS)) + MARGIN, float(np.quantile([made.mean(s) for s in random_back], MISSED)))
        return made

    @classmethod
    def trained(cls, secret: list[str], ordinary: list[str], seed: int = SEED) -> RandomStrings:
        rng = random.Random(seed)
        secret, words = sorted(set(secret))[:SAMPLE_VALUES], sorted(set(ordinary))[:SAMPLE_VALUES]
        letters, random_back = ALPHABET[:62], []
        for alphabet in (letters, ALPHABET[:64], letters + "-_", "0123456789abcdef", ALPHABET[26:62], ALPHABET[:52], ALPHABET[:26]):
            secret += ["".join(rng.choices(alphabet, k=rng.randint(LEAST, 48))) for _ in range(SAMPLE_VALUES // 5)]
            random_back += ["".join(rng.choices(alphabet, k=LEAST)) for _ in range(200)]

        def identifier(numbered: float) -> str:
            parts = rng.choices(ORDINARY, k=rng.randint(2, 5))
            if rng.random() < numbered:
                parts.append(str(rng.randint(0, 3000)))
            kind = rng.random()
            if kind < 0.1:  # numbers, times and rules are no secrets
                return rng.choice(("", "-", "_", "/")).join(str(rng.randint(0, 99999)) for _ in range(rng.randint(4, 8))) if kind < 0.08 else rng.choice("-=_+/") * rng.randint(LEAST, 60)
            return "".join(p.title() for p in parts) if kind < 0.35 else rng.choice("_-/.").join(parts) if kind < 0.9 else "_".join(parts).upper()

        seeded = [identifier(0.4) for _ in range(SAMPLE_VALUES)]
        seeded_back = [identifier(0.7) for _ in range(SAMPLE_VALUES)]
        rng.shuffle(secret)
        first = cls.between(secret, seeded, seeded_back, random_back)
        words = [w for w in words if not first.accepts(w)]  # secrets without a label, or what can't be told from them
        rng.shuffle(words)
        back = len(words) // 5
        return cls.between(secret, seeded + words[back:], seeded_back + words[:back], random_back)


def outside(spans: list[tuple[str, int, int]], matches: Iterator[re.Match]) -> Iterator[re.Match]:
    """Of matches in order, those that no span overlaps: one sweep over both."""
    left = sorted((a, b) for _, a, b in spans)
    at, upto = 0, -1
    for m in matches:
        while at < len(left) and left[at][0] < m.end():
            upto = max(upto, left[at][1])
            at += 1
        if upto <= m.start():
            yield m


def _sample_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Values of a document, labelled: 1 in base spans, 0 elsewhere."""
    for batch in batches:
        out: list[tuple[int, str]] = []
        for text in batch.column(0):
            text = text.as_py() or ""
            spans = base_spans(text)
            for kind, a, b in spans:
                value = ASSIGN.match(text, a, b)[2] if kind == "assign" else text[a:b]
                out.append((1, value[:64]))
            out += [(0, m[0]) for m in outside(spans, re.finditer(r"[A-Za-z0-9+/_=.-]{8,64}", text))]
        kept = sorted(set(out))
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in kept], pa.int32()), pa.array([x[1] for x in kept], pa.string())], names=["y", "value"])


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> RandomStrings:
    """Models from at most SAMPLE_DOCS documents and SAMPLE_VALUES values of each class."""
    picked = docs.select(F.col(id_col).alias("sample_id")).orderBy(F.md5(F.col("sample_id").cast("string"))).limit(SAMPLE_DOCS).distinct()
    texts = docs.select(F.col(id_col).alias("sample_id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(picked), "sample_id", "left_semi")
    values = texts.select("text").mapInArrow(_sample_batches, "y int, value string").distinct()
    order = F.md5("value")
    few = lambda y: [r.value for r in values.where(F.col("y") == y).orderBy(order, "value").limit(SAMPLE_VALUES).collect()]
    return RandomStrings.trained(few(1), few(0))


def scan(text: str, model: RandomStrings) -> list[tuple[str, int, int]]:
    spans = base_spans(text)
    if any(len(w) >= LEAST for w in text.split()):
        spans += [("random", *m.span()) for m in outside(spans, CANDIDATE.finditer(text)) if model.accepts(m[0])]
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


def _scan_batches(model: RandomStrings):
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [[{"kind": k, "start": a, "end": b} for k, a, b in scan(text.as_py() or "", model)] for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], names=["doc_id", "spans"])

    return run


def found(docs: DataFrame, model: RandomStrings, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, spans array<struct<kind, start, end>> in order of start, then of KINDS."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_scan_batches(model), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, spans array<struct<kind:string,start:long,end:long>>")


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = found(docs, fit(docs))
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != "random")
    return out.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
