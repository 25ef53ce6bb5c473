r"""Line dedup that can be taken back: sharded cuckoo filters over exact reference counts.

A line's key is the line, blanks [\x20\x09-\x0D] stripped at both ends and A-Z
lower-cased; its reference count is the number of documents that hold it. The
counts are a table (key digest, count) that insertions add to and deletions
subtract from. The keys with enough documents stand in cuckoo filters, one a
shard of the digest space, built and changed next to the counts: a key that
rises to the threshold is inserted, one that falls below is deleted; when the
keys outgrow the shards, these are dealt anew. Lines are asked of the filters alone,
about three bytes a key; only keys that these let through are held against the exact
table, so a false positive never drops a line.

Counting pre-aggregates in each task, so a line that every document holds costs
one row a batch. Filters that are measured to fit BROADCAST_BYTES go to the tasks, with
the few keys they are wrong about. Larger ones stay where they are: lines are dealt to
the shards, SALTS ways each so that a common line is spread, and stream past their
filter; what it lets through meets the exact table by a join. Keys are known by
128 bits of a hash of the whole key.

Defined cases: null or empty text is one empty line; an empty key is never
dropped; a document that repeats a line counts once for it; rows that repeat a
doc_id are separate documents; a deletion must name documents as they were
inserted; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import struct
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.llm.store import BROADCAST_BYTES, small_enough, written

MIN_DOCS, MIN_CHARS = 10, 1
#: Keys that one shard's filter is laid out for; shards with over twice as many on average are dealt anew.
SHARD_KEYS, LEAST_SHARDS, SALTS = 200_000, 16, 16
BLANKS = b" \t\n\x0b\x0c\r"
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def key_of(line: bytes) -> bytes:
    return line.strip(BLANKS).translate(LOWER)


def digest_of(key: bytes) -> bytes:
    return xxhash.xxh3_128_digest(key)


def keys_of(text: bytes, min_chars: int) -> list[bytes | None]:
    """The key of each line, None where it is too short to be dropped."""
    keys = map(key_of, text.split(b"\n"))
    if min_chars <= 1:
        return [k if len(k) >= min_chars else None for k in keys]
    return [k if len(k.decode()) >= min_chars else None for k in keys]


class CuckooFilter:
    """Fingerprints of 16 bits in buckets of four; keys are digests of 16 bytes.

    An insertion that finds no room after KICKS moves doubles the table, which
    the digests kept by the caller refill.
    """

    SLOTS, KICKS = 4, 500

    def __init__(self, capacity: int):
        self.buckets = 1 << max(1, (max(1, capacity) * 5 // 4 // self.SLOTS)).bit_length()
        self.table = np.zeros((self.buckets, self.SLOTS), np.uint16)

    def _places(self, digest: bytes) -> tuple[int, int, int]:
        low, high = struct.unpack("<QQ", digest)
        mark = (high & 0xFFFF) or 1
        first = low & (self.buckets - 1)
        return mark, first, first ^ (mark * 0x5BD1E995 & (self.buckets - 1))

    def insert(self, digest: bytes) -> bool:
        mark, first, second = self._places(digest)
        for bucket in (first, second):
            free = np.flatnonzero(self.table[bucket] == 0)
            if len(free):
                self.table[bucket, free[0]] = mark
                return True
        bucket = second
        for kick in range(self.KICKS):
            slot = kick % self.SLOTS
            mark, self.table[bucket, slot] = int(self.table[bucket, slot]), mark
            bucket ^= mark * 0x5BD1E995 & (self.buckets - 1)
            free = np.flatnonzero(self.table[bucket] == 0)
            if len(free):
                self.table[bucket, free[0]] = mark
                return True
        return False

    def delete(self, digest: bytes) -> bool:
        mark, first, second = self._places(digest)
        for bucket in (first, second):
            at = np.flatnonzero(self.table[bucket] == mark)
            if len(at):
                self.table[bucket, at[0]] = 0
                return True
        return False

    def holds(self, digest: bytes) -> bool:
        mark, first, second = self._places(digest)
        return bool((self.table[first] == mark).any() or (self.table[second] == mark).any())

    def holds_many(self, digests: list[bytes]) -> np.ndarray:
        both = np.frombuffer(b"".join(digests), "<u8").reshape(-1, 2)
        mark = (both[:, 1] & np.uint64(0xFFFF)).astype(np.int64)
        mark[mark == 0] = 1
        first = (both[:, 0] & np.uint64(self.buckets - 1)).astype(np.int64)
        second = first ^ (mark * 0x5BD1E995 & (self.buckets - 1))
        return (self.table[first] == mark[:, None]).any(1) | (self.table[second] == mark[:, None]).any(1)

    def to_bytes(self) -> bytes:
        return self.table.tobytes()

    @classmethod
    def from_bytes(cls, blob: bytes) -> CuckooFilter:
        made = cls.__new__(cls)
        made.table = np.frombuffer(blob, np.uint16).reshape(-1, cls.SLOTS).copy()
        made.buckets = len(made.table)
        return made

    @classmethod
    def of(cls, digests: list[bytes]) -> CuckooFilter:
        capacity = len(digests)
        while True:
            made = cls(capacity)
            if all(map(made.insert, digests)):
                return made
            capacity *= 2


def shard_of(digest: bytes, shards: int) -> int:
    return int.from_bytes(digest[12:], "big") % shards


def shard_column(shards: int):
    return (F.conv(F.hex(F.substring("digest", 13, 4)), 16, 10).cast("long") % shards).cast("int")


def _count_batches(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter[bytes] = Counter()
            for text in batch.column(0):
                seen.update({digest_of(k) for k in keys_of(text.as_py() or b"", min_chars) if k is not None})
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["digest", "n"])

    return run


def _filter_shards(min_docs: int):
    """Updates of shards: rows (shard, digest, was, now, old filter) to filters."""

    def run(key, table):
        digests, was, now = (table.column(c).to_pylist() for c in ("digest", "was", "now"))
        old = next((x for x in table.column("filter").to_pylist() if x is not None), None)
        held = None
        if old is not None:
            held = CuckooFilter.from_bytes(old)
            for d, w, n in zip(digests, was, now, strict=True):
                if w >= min_docs > n:
                    held.delete(d)
            if not all(held.insert(d) for d, w, n in zip(digests, was, now, strict=True) if w < min_docs <= n):
                held = None
        if held is None:
            held = CuckooFilter.of([d for d, n in zip(digests, now, strict=True) if n >= min_docs])
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "filter": pa.array([held.to_bytes()], pa.binary())})

    return run


def _let_through(filters: dict[int, CuckooFilter], shards: int, digests: set[bytes]) -> set[bytes]:
    """Those of digests that their shard's filter holds."""
    by_shard: dict[int, list[bytes]] = {}
    for d in digests:
        by_shard.setdefault(shard_of(d, shards), []).append(d)
    asked = ((order, filters[shard].holds_many(order)) for shard, order in by_shard.items() if shard in filters)
    return {d for order, held in asked for d, h in zip(order, held, strict=True) if h}


def _digests(text: bytes, min_chars: int) -> list[bytes | None]:
    return [digest_of(k) if k is not None else None for k in keys_of(text, min_chars)]


def _held_batches(filters: dict[int, CuckooFilter], shards: int, min_chars: int):
    """The digests of rows (text) that the filters let through, once a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = {d for t in batch.column(0) for d in _digests(t.as_py() or b"", min_chars) if d is not None}
            yield pa.RecordBatch.from_arrays([pa.array(list(_let_through(filters, shards, seen)), pa.binary())], names=["digest"])

    return run


def _rewrite(filters: dict[int, CuckooFilter], wrong: set[bytes], shards: int, min_chars: int):
    """Documents without the lines that the filters hold, but for the digests they are wrong about."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_py() or b"" for t in batch.column(1)]
            digests = [_digests(t, min_chars) for t in texts]
            gone = _let_through(filters, shards, set().union(*digests) - {None}) - wrong
            out: list[tuple[int, int, bytes]] = []
            for text, mine in zip(texts, digests, strict=True):
                dropped = sum(d in gone for d in mine) if gone else 0
                if dropped:
                    text = b"\n".join([x for x, d in zip(text.split(b"\n"), mine, strict=True) if d not in gone])
                out.append((len(mine), dropped, text))
            columns = [pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2].decode() for x in out], pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "n_lines", "n_dropped", "kept_text"])

    return run


def _line_batches(min_chars: int):
    """row, digest, at of rows (row, text): each line's digest once a document, with its positions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, digests, places = [], [], []
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found: dict[bytes, list[int]] = {}
                for i, d in enumerate(_digests(text.as_py() or b"", min_chars)):
                    if d is not None:
                        found.setdefault(d, []).append(i)
                rows += [row] * len(found)
                digests += found
                places += found.values()
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(digests, pa.binary()), pa.array(places, pa.list_(pa.int32()))], names=["row", "digest", "at"])

    return run


def _stream_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """row, digest, at that the filter of their shard holds, from rows in order of shard, the filter ahead of its lines."""
    shard, held = None, None
    for batch in batches:
        shards, keep = batch.column(0).to_numpy(), []
        cuts = np.flatnonzero(np.concatenate(([True], shards[1:] != shards[:-1], [True]))) if len(shards) else np.zeros(0, int)
        for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if shards[i] != shard:
                shard, held = shards[i], None
            for at in range(i, j):  # a shard may come in several salts, each with the filter ahead
                if batch.column(4)[at].is_valid:
                    held = CuckooFilter.from_bytes(batch.column(4)[at].as_py())
                else:
                    break
            lines = [at for at in range(i, j) if batch.column(2)[at].is_valid] if held is not None else []
            if lines:
                keep += np.array(lines)[held.holds_many(batch.column(2).take(pa.array(lines)).to_pylist())].tolist()
        yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(keep, pa.int64())) for c in (1, 2, 3)], names=["row", "digest", "at"])


class LineIndex:
    """Reference counts of line keys and the cuckoo filters over those at the threshold.

    insert() and delete() return a new index and leave this one as it was, so a
    failed step can be run again; both go over the given documents only.
    """

    COUNTS, FILTERS = "digest binary, n long", "shard int, filter binary"

    def __init__(self, spark: SparkSession, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, shards: int | None = None, fixed: bool = False, counts: DataFrame | None = None, filters: DataFrame | None = None):
        self.spark, self.min_docs, self.min_chars, self.shards, self.fixed = spark, min_docs, max(1, min_chars), shards, fixed
        self.counts, self.filters = counts, filters

    def insert(self, docs: DataFrame, text_col: str = "text") -> LineIndex:
        return self._changed(docs, text_col, 1)

    def delete(self, docs: DataFrame, text_col: str = "text") -> LineIndex:
        return self._changed(docs, text_col, -1)

    def _changed(self, docs: DataFrame, text_col: str, sign: int) -> LineIndex:
        texts = docs.select(F.col(text_col).cast("string").cast("binary").alias("text"))
        rows = texts.mapInArrow(_count_batches(self.min_chars), self.COUNTS).select("digest", (F.lit(sign) * F.col("n")).alias("d"), F.lit(0).cast("long").alias("was"))
        if self.counts is not None:
            rows = rows.unionByName(self.counts.select("digest", F.col("n").alias("d"), F.col("n").alias("was")))
        counts = written(rows.groupBy("digest").agg(F.sum("d").alias("now"), F.sum("was").alias("was")).where("now <> 0 or was <> 0"), "line-counts")
        crossing = counts.where((F.col("now") >= self.min_docs) | (F.col("was") >= self.min_docs))
        wanted = max(LEAST_SHARDS, -(-counts.where(F.col("now") >= self.min_docs).count() // SHARD_KEYS))
        old, shards = self.filters, self.shards or wanted
        if wanted > 2 * shards and not self.fixed:  # dealt anew, from the counts alone
            old, shards = None, wanted
            crossing = counts.where(F.col("now") >= self.min_docs).withColumn("was", F.lit(0).cast("long"))
        moved = crossing.select(shard_column(shards).alias("shard"), "digest", "was", "now", F.lit(None).cast("binary").alias("filter"))
        if old is not None:
            moved = moved.unionByName(old.select("shard", F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("was"), F.lit(0).cast("long").alias("now"), "filter"))
        filters = written(moved.groupBy("shard").applyInArrow(_filter_shards(self.min_docs), self.FILTERS), "line-filters")
        return LineIndex(self.spark, self.min_docs, self.min_chars, shards, self.fixed, counts.where("now > 0").select("digest", F.col("now").alias("n")), filters)

    def dropped_keys(self) -> DataFrame:
        return self.counts.where(F.col("n") >= self.min_docs).select("digest")

    def apply(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """doc_id, n_lines, n_dropped, kept_text of each document."""
        rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
        size = self.filters.agg(F.coalesce(F.sum(F.octet_length("filter")), F.lit(0))).first()[0]
        if size > BROADCAST_BYTES:
            return self._apply_shuffled(rows)
        filters = {r.shard: CuckooFilter.from_bytes(bytes(r.filter)) for r in self.filters.collect()}  # as large as measured
        held = rows.select("text").mapInArrow(_held_batches(filters, self.shards, self.min_chars), "digest binary").distinct()
        wrong = written(held.join(self.dropped_keys(), "digest", "left_anti"), "wrong-lines")
        if not small_enough(wrong):
            return self._apply_shuffled(rows)
        kind = rows.schema["doc_id"].dataType.simpleString()
        return rows.mapInArrow(_rewrite(filters, {bytes(r.digest) for r in wrong.collect()}, self.shards, self.min_chars), f"doc_id {kind}, n_lines long, n_dropped long, kept_text string")

    def _apply_shuffled(self, rows: DataFrame) -> DataFrame:
        """The same with the filters left in place: lines stream past their shard's, and come back to their document as positions."""
        at = written(rows.withColumn("row", F.monotonically_increasing_id()), "line-rows")
        lines = at.select("row", "text").mapInArrow(_line_batches(self.min_chars), "row long, digest binary, at array<int>")
        none = F.lit(None)
        lines = lines.select(shard_column(self.shards).alias("shard"), "row", "digest", "at", none.cast("binary").alias("filter"), F.pmod("row", F.lit(SALTS)).cast("int").alias("salt"))
        filters = self.filters.select("shard", none.cast("long").alias("row"), none.cast("binary").alias("digest"), none.cast("array<int>").alias("at"), "filter", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        dealt = lines.unionByName(filters).repartition("shard", "salt").sortWithinPartitions("shard", "salt", F.col("row").asc_nulls_first())
        held = dealt.drop("salt").mapInArrow(_stream_batches, "row long, digest binary, at array<int>")
        gone = held.join(self.dropped_keys(), "digest", "left_semi").groupBy("row").agg(F.flatten(F.collect_list("at")).alias("gone"))
        all_lines = F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), "\n", -1)
        out = at.join(gone, "row", "left").select("doc_id", all_lines.alias("lines"), F.coalesce("gone", F.array().cast("array<int>")).alias("gone"))
        stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone")
        kept = F.array_join(F.transform(stay, lambda i: F.get("lines", i)), "\n")
        return out.select("doc_id", F.size("lines").cast("long").alias("n_lines"), F.size("gone").cast("long").alias("n_dropped"), kept.alias("kept_text"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = LineIndex(spark).insert(docs).apply(docs)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


SQL = r"""
WITH l AS (
  SELECT doc_id, i, lines[i] AS line, translate(trim(lines[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents), LATERAL (SELECT unnest(generate_series(1, len(lines))) AS i)),
hot AS (SELECT key FROM l WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (h.key IS NOT NULL) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (h.key IS NULL), '')) AS kept_sha256
FROM l LEFT JOIN hot h ON l.key = h.key GROUP BY doc_id
"""
