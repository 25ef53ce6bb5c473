r"""MinHash near-dedup with sequential Bayesian verification.

A document's set holds its distinct word shingles. Signatures of PERMUTATIONS
minimum hashes are cut into BANDS bands; documents that share a band are
candidates (a pair at the threshold shares none with probability 1e-7). A
candidate's signatures are compared batch by batch, and the pair is dropped as
soon as the posterior probability of a similarity of at least the threshold,
given the matches so far and a uniform prior, falls under MISS. Survivors are
verified on the full sets of words.

Equal word sequences are one node. Within a bucket each member is first paired
with one hub, not with all others; what those pairs link is joined. Buckets that
still hold several components are then searched whole, but only between
components: all members outside the bucket's largest component against all
others. Both sides are split into parts of about BLOCK, and signatures alone go to
the cells where one part meets another. A cell asks for the sets of those of its documents that some
signature leaves likely, settles them by the hashes of their whole sets, and only pairs
that join two components leave it as rows, to be confirmed on the words. Pairs inside a
component are never looked at, so no component is lost and no group is expanded into its pairs.

Ids are read as whole numbers of 64 bits; an id that is none is an error in ANSI mode, else null.

Defined cases: null text and texts without words have the empty set and link
with nothing; one word is a set of one; rows that repeat a doc_id are one document
to the links, each with its own set size; a null doc_id links with nothing; an
empty table gives no rows; columns other than id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.components import connected_components
from palisade.llm.store import semi, small_batches, trim_memory, written

WORDS, THRESHOLD = 2, 0.8
BANDS, BAND_ROWS = 40, 5
PERMUTATIONS = BANDS * BAND_ROWS
BATCH, MISS, SEED = 25, 1e-6, 5
#: Members of a bucket's largest component, and rivals of it, that are searched in one array.
BLOCK = 1024
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    """Words: bytes.split() parts at exactly the blanks the contract names."""
    return (text or b"").translate(LOWER).split()


def shingles(words: list[bytes], n: int) -> set[tuple[bytes, ...]]:
    if not words:
        return set()
    return {tuple(words)} if len(words) < n else set(zip(*(words[i:] for i in range(n)), strict=False))


def _constants() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return rng.integers(0, 1 << 32, PERMUTATIONS, dtype=np.uint32), rng.integers(0, 1 << 31, PERMUTATIONS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def _signature(hashes: np.ndarray, flip: np.ndarray, odd: np.ndarray) -> np.ndarray:
    least = np.full(PERMUTATIONS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(hashes), 512):
        part = hashes[at : at + 512, None] ^ flip
        part *= odd
        part ^= part >> np.uint32(15)
        part *= np.uint32(0x2C1B3C6D)
        np.minimum(least, part.min(0), out=least)
    return least


def _sign_batches(n_words: int, whole: bool = False):
    """Signatures and bands; or, if whole, signatures with the sorted hashes of the whole set."""
    flip, odd = _constants()
    band_seed = np.random.default_rng(SEED + 1).integers(1, 1 << 62, (BANDS, BAND_ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    mix, step = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = xxhash.xxh3_64_intdigest
        for batch in batches:
            digests, sizes, signatures, bands, sets = [], [], [], [], []
            for text in batch.column(1):
                words = words_of(text.as_py())
                if not words:
                    digests.append(None), sizes.append(0), signatures.append(None), bands.append([]), sets.append(None)
                    continue
                h = np.fromiter(map(hashed, words), np.uint64, len(words))
                width = min(n_words, len(words))
                s = np.zeros(len(h) - width + 1, np.uint64)
                for k in range(width):
                    s = (s ^ h[k : len(h) - width + 1 + k]) * mix
                    s ^= s >> np.uint64(29)
                s = np.unique(s * step)
                least = _signature((s >> np.uint64(32)).astype(np.uint32), flip, odd)
                signatures.append((least & np.uint32(0xFFFF)).astype("<u2").tobytes())
                if whole:
                    sets.append(s.tobytes())
                    continue
                keys = (least.reshape(BANDS, BAND_ROWS).astype(np.uint64) * band_seed).sum(1, dtype=np.uint64)
                keys = (keys ^ (keys >> np.uint64(31))) * mix + np.arange(BANDS, dtype=np.uint64)
                digests.append(hashlib.sha256(b" ".join(words)).digest())
                sizes.append(len(s))
                bands.append(keys.view(np.int64))
            if whole:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(signatures, pa.binary()), pa.array(sets, pa.binary())], names=["doc_id", "signature", "hashes"])
                continue
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), pa.array(signatures, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                names=["doc_id", "digest", "n_shingles", "signature", "bands"],
            )
            batch = None
            trim_memory()

    return run


def least_matches(threshold: float = THRESHOLD, miss: float = MISS, batch: int = BATCH, n: int = PERMUTATIONS) -> list[tuple[int, int]]:
    """(hashes compared, matches below which the pair is dropped) for each batch.

    With a uniform prior the posterior after m matches of k is Beta(m+1, k-m+1);
    P(similarity >= t) equals P(Binomial(k+1, t) <= m).
    """
    from math import comb

    out = []
    for k in range(batch, n + 1, batch):
        below, m = 0.0, 0
        while True:
            below += comb(k + 1, m) * threshold**m * (1 - threshold) ** (k + 1 - m)
            if below >= miss:
                break
            m += 1
        out.append((k, m))
    return out


def _prune_batches(bounds: list[tuple[int, int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            one, two = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(-1, PERMUTATIONS) for c in (2, 3))
            alive, matches, done = np.arange(len(one)), np.zeros(len(one), np.int64), 0
            for upto, least in bounds:
                matches[alive] += (one[alive, done:upto] == two[alive, done:upto]).sum(1)
                alive, done = alive[matches[alive] >= least], upto
            keep = pa.array(alive)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(1).take(keep)], names=["a", "b"])

    return run


def _cells(names: list[str], kinds: list[pa.DataType], found):
    """found(table) -> columns of each cell's rows, which come in order of main and block; an open cell is copied once, when it is whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[pa.RecordBatch] = []
        last: tuple[int, int] | None = None

        def closed() -> pa.RecordBatch:
            t = pa.Table.from_batches(parts).combine_chunks()
            parts.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(found(t), kinds, strict=True)], names=names)

        for batch in batches:
            if not batch.num_rows:
                continue
            key, block = batch.column("main").to_numpy(), batch.column("block").to_numpy()
            starts = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (block[1:] != block[:-1])))).tolist()
            for i, j in zip(starts, [*starts[1:], batch.num_rows], strict=True):
                if parts and last != (key[i], block[i]):
                    yield closed()
                last = (key[i], block[i])
                parts.append(batch.slice(i, j - i))
        if parts:
            yield closed()
        trim_memory()

    return run


def _likely(t: pa.Table, bounds: list[tuple[int, int]], percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """(i, rows j by falling matches) of each rival i: those of other components whose sizes and signatures leave the threshold possible."""
    rival, home = t.column("rival").to_numpy().astype(bool), t.column("home").to_numpy().astype(bool)
    n, component = (t.column(c).to_numpy() for c in ("n", "component"))
    signs = np.frombuffer(b"".join(t.column("signature").to_pylist()), "<u2").reshape(-1, PERMUTATIONS)
    others = np.flatnonzero(~rival | home)
    for i in np.flatnonzero(rival).tolist():
        fits = np.minimum(n[i], n[others]) * 100 >= np.maximum(n[i], n[others]) * percent
        alive = others[(component[others] != component[i]) & fits]
        matches, done = np.zeros(len(alive), np.int64), 0
        for upto, least in bounds:
            if not len(alive):
                break
            matches += (signs[alive, done:upto] == signs[i, done:upto]).sum(1)
            keep = matches >= least
            alive, matches, done = alive[keep], matches[keep], upto
        if len(alive):
            yield i, alive[np.argsort(-matches, kind="stable")]


def _asking_batches(bounds: list[tuple[int, int]], percent: int):
    """main, block, doc_id of the rows whose sets a cell has to see, from rows (main, block, rival, home, doc_id, n, component, signature)."""

    def found(t: pa.Table) -> list:
        asked = np.zeros(t.num_rows, bool)
        for i, alive in _likely(t, bounds, percent):
            asked[i] = True
            asked[alive] = True
        ids = np.unique(t.column("doc_id").to_numpy()[asked])
        return [np.repeat(t.column(c)[0].as_py(), len(ids)) for c in ("main", "block")] + [ids]

    return _cells(["main", "block", "doc_id"], [pa.int64()] * 3, found)


def _search_batches(bounds: list[tuple[int, int]], percent: int):
    """Pairs (a, b) that join components, from rows (main, block, rival, home, doc_id, n, component, signature, hashes)."""

    def similar(a: np.ndarray, b: np.ndarray) -> bool:
        both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
        return 100 * both >= percent * (len(a) + len(b) - both)

    def found(t: pa.Table) -> list:
        ids, component = (t.column(c).to_numpy() for c in ("doc_id", "component"))
        sets = [np.frombuffer(x.as_buffer(), "<u8") for x in t.column("hashes")]
        up: dict[int, int] = {}
        pairs = []

        def root(c: int) -> int:
            while c in up:
                c = up[c]
            return c

        for i, alive in _likely(t, bounds, percent):
            for j in alive.tolist():
                x, y = root(int(component[i])), root(int(component[j]))
                if x != y and similar(sets[i], sets[j]):
                    up[max(x, y)] = min(x, y)
                    pairs.append((min(int(ids[i]), int(ids[j])), max(int(ids[i]), int(ids[j]))))
        return [[p[0] for p in pairs], [p[1] for p in pairs]]

    return _cells(["a", "b"], [pa.int64()] * 2, found)


def _verify_batches(n_words: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, last, left = [], None, set()
            for i in range(batch.num_rows):
                hub = batch.column(0)[i].as_py()
                if hub != last:
                    last, left = hub, shingles(words_of(batch.column(2)[i].as_py()), n_words)
                right = shingles(words_of(batch.column(3)[i].as_py()), n_words)
                both = len(left & right)
                if 100 * both >= percent * (len(left) + len(right) - both):
                    keep.append(i)
            rows = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows)], names=["a", "b"])
            trim_memory()

    return run


class NearDuplicates:
    """The stages of one run over docs (doc_id, text); components() is the result."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, n_words: int, percent: int):
        self.n_words, self.percent = n_words, percent
        self.texts = small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
        self.signed = written(self.texts.mapInArrow(_sign_batches(n_words), "doc_id long, digest binary, n_shingles long, signature binary, bands array<long>"), "signatures")
        named = self.signed.where("doc_id is not null and digest is not null")
        groups = named.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("other")).where("rep <> other").select("digest", "rep")
        groups = written(groups, "equal-texts")
        self.copies = written(named.select("doc_id", "digest").join(groups, "digest").where("doc_id <> rep").select("doc_id", "rep").distinct(), "copies")
        self.nodes = semi(named, self.copies.select("doc_id"), ["doc_id"], how="left_anti")

    def members(self) -> DataFrame:
        """key, doc_id, n, hub: rows of the buckets that hold two nodes or more."""
        rows = self.nodes.select(F.explode("bands").alias("key"), "doc_id", F.col("n_shingles").alias("n"))
        several = rows.groupBy("key").agg(F.min("doc_id").alias("hub"), F.max("doc_id").alias("other")).where("hub <> other").select("key", "hub")
        return written(rows.join(written(several, "buckets"), "key"), "members")

    def survivors(self, pairs: DataFrame) -> DataFrame:
        """Of pairs (a, b), those whose signatures leave the threshold possible."""
        pairs = written(pairs, "pairs")
        ids = pairs.select(F.col("a").alias("doc_id")).unionAll(pairs.select("b")).distinct()
        signature = written(semi(self.nodes.select("doc_id", "signature"), written(ids, "asked"), ["doc_id"]), "asked-signatures")
        both = pairs.join(signature.select(F.col("doc_id").alias("a"), F.col("signature").alias("s")), "a").join(signature.select(F.col("doc_id").alias("b"), F.col("signature").alias("t")), "b")
        return both.select("a", "b", "s", "t").mapInArrow(_prune_batches(least_matches(self.percent / 100)), "a long, b long")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """Of pairs (a, b), those whose full sets are similar enough."""
        pairs = written(pairs, "survivors")
        ids = written(pairs.select(F.col("a").alias("doc_id")).unionAll(pairs.select("b")).distinct(), "survivor-ids")
        texts = written(semi(self.texts, ids, ["doc_id"]), "survivor-texts")
        both = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("s")), "a").join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("t")), "b")
        return written(both.select("a", "b", "s", "t").mapInArrow(_verify_batches(self.n_words, self.percent), "a long, b long"), "links")

    def components(self) -> DataFrame:
        """doc_id, component of all documents that link with another or equal one."""
        members = self.members()
        links = self.verified(self.survivors(members.where("doc_id <> hub").select(F.col("hub").alias("a"), F.col("doc_id").alias("b")).distinct()))
        found = written(connected_components(links), "components")
        more = self.verified(self.between_components(members.drop("hub"), found).distinct())
        if not more.isEmpty():
            # components stand for their members: only what joins them is left to solve
            name = lambda c: found.select(F.col("id").alias(c), F.col("component").alias(f"{c}_part"))
            joined = more.join(name("a"), "a", "left").join(name("b"), "b", "left").select(F.coalesce("a_part", "a").alias("a"), F.coalesce("b_part", "b").alias("b"))
            over = written(connected_components(joined), "joined-components").withColumnRenamed("id", "part").withColumnRenamed("component", "whole")
            moved = found.join(over, found["component"] == over["part"], "left").select("id", F.coalesce("whole", "component").alias("component"))
            alone = over.join(found.select(F.col("id").alias("part")), "part", "left_anti").select(F.col("part").alias("id"), F.col("whole").alias("component"))
            found = written(moved.unionAll(alone), "components")
        merged = self.copies.join(found.select(F.col("id").alias("rep"), "component"), "rep", "left").select("doc_id", F.coalesce("component", "rep").alias("component"))
        alone = self.copies.select("rep").distinct().join(found.select(F.col("id").alias("rep")), "rep", "left_anti")
        return merged.unionAll(found.select("id", "component")).unionAll(alone.select("rep", F.col("rep").alias("component")))

    def between_components(self, members: DataFrame, found: DataFrame) -> DataFrame:
        """Pairs (a, b) that join components: all that share a bucket are compared, by signature, then by the hashes of their sets.

        Buckets with the same largest component are searched together, as their members mostly are the same.
        """
        rows = members.join(found.select(F.col("id").alias("doc_id"), "component"), "doc_id", "left").select("key", "doc_id", "n", F.coalesce("component", "doc_id").alias("component"))
        rows = written(rows, "labelled")
        counts = rows.groupBy("key", "component").agg(F.count("*").alias("c"))
        buckets = counts.groupBy("key").agg(F.max(F.struct("c", "component")).alias("largest"), F.count("*").alias("parts")).where("parts > 1")
        buckets = written(buckets.select("key", F.col("largest.component").alias("main")), "open-buckets")
        rows = written(rows.join(buckets, "key").select("main", "doc_id", "n", "component").distinct(), "open")
        ids = written(rows.select("doc_id").distinct(), "open-ids")
        rows = rows.withColumn("rival", F.col("component") != F.col("main"))
        parts_of = lambda side: F.greatest(F.lit(1), F.ceil(F.count_if(side) / BLOCK)).cast("int")
        parts = rows.groupBy("main").agg(parts_of(~F.col("rival")).alias("blocks"), parts_of(F.col("rival")).alias("rivals"))
        rows = rows.join(written(parts, "open-blocks"), "main")
        rows = rows.withColumn("at", F.pmod(F.xxhash64("doc_id"), F.when(F.col("rival"), F.col("rivals")).otherwise(F.col("blocks"))).cast("int"))
        # cell (p, q): part p of the rivals against block q of the others, or for q >= blocks against part q - blocks of the rivals, p at most that
        own, last = F.col("blocks") + F.col("at"), F.col("blocks") + F.col("rivals") - 1
        cell = lambda p, q, seeks: F.struct((F.shiftleft(p.cast("long"), 32) + q.cast("long")).alias("block"), seeks.alias("seeks"), (seeks & (q == own)).alias("home"))
        seeker = F.transform(F.concat(F.sequence(F.lit(0), F.col("blocks") - 1), F.sequence(own, last)), lambda q: cell(F.col("at"), q, F.lit(True)))
        sought = F.transform(F.filter(F.sequence(F.lit(0), F.col("at")), lambda p: p < F.col("at")), lambda p: cell(p, own, F.lit(False)))
        plain = F.transform(F.sequence(F.lit(0), F.col("rivals") - 1), lambda p: cell(p, F.col("at"), F.lit(False)))
        rows = rows.withColumn("cell", F.explode(F.when(F.col("rival"), F.concat(seeker, sought)).otherwise(plain)))
        rows = written(rows.select("main", "cell.block", F.col("cell.seeks").alias("rival"), "cell.home", "doc_id", "n", "component"), "cells")
        bounds, cell = least_matches(self.percent / 100), ["main", "block"]
        signatures = written(semi(self.nodes.select("doc_id", "signature"), ids, ["doc_id"]), "open-signatures")
        signed = rows.join(signatures, "doc_id").select(*rows.columns, "signature").repartition(*cell).sortWithinPartitions(*cell)
        asked = written(signed.mapInArrow(_asking_batches(bounds, self.percent), "main long, block long, doc_id long"), "asking")
        texts = semi(self.texts, written(asked.select("doc_id").distinct(), "asking-ids"), ["doc_id"])
        sets = written(texts.mapInArrow(_sign_batches(self.n_words, whole=True), "doc_id long, signature binary, hashes binary"), "open-sets")
        seen = rows.join(asked, [*cell, "doc_id"]).join(sets, "doc_id").select(*rows.columns, "signature", "hashes")
        return seen.repartition(*cell).sortWithinPartitions(*cell).mapInArrow(_search_batches(bounds, self.percent), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row."""
    run = NearDuplicates(docs, id_col, text_col, n_words, percent)
    found = written(run.components(), "near")
    out = run.signed.select("doc_id", "n_shingles").join(found, "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), n_words=WORDS)


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) > 1 THEN list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) WHEN len(ws) = 1 THEN ws ELSE [] END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 80 * (nx.n + ny.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT x AS doc_id, x AS root FROM e UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.doc_id),
c AS (SELECT doc_id, min(root) AS root FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.root, d.doc_id) AS component_id, coalesce(c.root, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.doc_id = d.doc_id
"""
