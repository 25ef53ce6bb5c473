"""Periodic runs of words, by the algorithm of Kolpakov and Kucherov.

A run is a stretch of words with smallest period q, at least `least` words and at
least 2 * q long, that no neighbouring word extends keeping q. Of each text

1. words become numbers, and stretches that hold no run are left out: both the part of a run
   before its last q words and the copy of that part q words on are at least half of
   `least` words long, so every word of a run lies in a group of ceil(least / 2)
   words that the same stretch holds twice. What such groups cover is cut out, and again
   within each piece (CUTS times at most, as a piece may always hold more than its runs).
   Groups are compared by a hash; a collision only leaves more to the next step.
2. A piece's Lempel-Ziv factors are read from its suffix automaton: the longest
   beginning of what remains that occurs earlier, or a new word.
3. Main's algorithm finds at each border of factors the runs that cross or touch it,
   by the longest extensions of both sides (Z values). A run that ends in the
   factor after a border begins less than twice the factor before and once
   the factor after in front of it, so the windows are together linear in the text.
4. The other runs lie inside a factor and are copied from its earlier occurrence.

Time and memory are linear in a text, and texts are independent: one pass
without a shuffle. Of a run all words after its first q go from the collapsed text.

Defined cases: null text counts as empty; a text without words has no runs and an
empty collapsed text; rows that repeat an id give a row each; a null id stays
null; an empty table gives no rows; columns other than id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.llm.arrays import bound
from palisade.llm.store import small_batches, trim_memory

LEAST, CUTS = 12, 4
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
MIX = np.uint64(0x9E3779B97F4A7C15)


def pieces(ids: np.ndarray, size: int) -> list[tuple[int, int]]:
    """Ascending stretches [start, end) outside of which there is no run."""
    n = len(ids)
    if n < 2 * size - 1:
        return []
    groups = np.zeros(n - size + 1, np.uint64)
    for k in range(size):
        groups = (groups ^ ids[k : n - size + 1 + k].astype(np.uint64)) * MIX
        groups ^= groups >> np.uint64(29)
    places, piece, spans = np.arange(len(groups)), np.zeros(len(groups), np.int64), [(0, n)]
    for _ in range(CUTS):
        order = np.lexsort((groups[places], piece))
        same = (groups[places][order][1:] == groups[places][order][:-1]) & (piece[order][1:] == piece[order][:-1])
        twice = np.zeros(len(places), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        left = places[twice]
        breaks = np.diff(left) > size  # the words between are in no group
        cut = np.cumsum(np.concatenate([np.zeros(min(1, len(left)), np.int64), breaks]))
        ends = np.flatnonzero(np.concatenate([breaks, np.ones(min(1, len(left)), bool)]))
        starts = np.concatenate([np.zeros(min(1, len(left)), np.int64), ends[:-1] + 1])
        spans = list(zip(left[starts].tolist(), (left[ends] + size).tolist(), strict=True))
        inside = np.zeros(n + 1, np.int64)  # groups of words that a piece holds, whether found twice so far or not
        for s, e in spans:
            inside[s] += 1
            inside[e - size + 1] -= 1
        again = np.flatnonzero(np.cumsum(inside)[: len(groups)])
        if len(again) in (0, len(places)):
            break
        places, piece = again, np.searchsorted(np.array([s for s, _ in spans]), again, "right")
    return spans


def factors(word: list[int]) -> list[tuple[int, int, int]]:
    """start, length and an earlier start (-1: a new word) of each Lempel-Ziv factor, by the suffix automaton."""
    follow, link, length, ends = [{}], [-1], [0], [-1]  # ends: where a state's words end first
    last = 0
    for i, c in enumerate(word):
        state = len(follow)
        follow.append({})
        length.append(i + 1)
        link.append(0)
        ends.append(i)
        p = last
        while p >= 0 and c not in follow[p]:
            follow[p][c] = state
            p = link[p]
        if p >= 0:
            q = follow[p][c]
            if length[q] == length[p] + 1:
                link[state] = q
            else:
                twin = len(follow)
                follow.append(follow[q].copy())
                length.append(length[p] + 1)
                link.append(link[q])
                ends.append(ends[q])
                while p >= 0 and follow[p].get(c) == q:
                    follow[p][c] = twin
                    p = link[p]
                link[q] = link[state] = twin
        last = state
    out, at, n = [], 0, len(word)
    while at < n:
        state, to = 0, at
        while to < n:
            state_next = follow[state][word[to]]
            if ends[state_next] >= to:
                break
            state, to = state_next, to + 1
        out.append((at, to - at, ends[state] + 1 - (to - at)) if to > at else (at, 1, -1))
        at = max(to, at + 1)
    return out


def z_values(s: list[int], wanted: int) -> list[int]:
    """Length of the longest common beginning of s and s[i:], for i below wanted."""
    z, n = [0] * wanted, len(s)
    left = right = 0
    for i in range(1, wanted):
        k = 0
        if i < right:
            k = z[i - left]
            if k < right - i:
                z[i] = k
                continue
            k = right - i
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def at_border(word: list[int], before: int, border: int, after: int, least: int) -> Iterator[tuple[int, int, int]]:
    """start, end and period of runs that end in [border, after) and begin before or at border, or end right before it."""
    first, second = border - before, after - border
    if 2 * (first + second) < least:
        return
    low, high = max(0, border - 2 * first - second - 1), min(len(word), after + 1)
    left, right = word[low:border], word[border:high]
    back = left[::-1]
    ahead = z_values([*right, -1, *left, *right], len(right) + 1 + len(left))  # -1 is no word
    behind = z_values([*back, -1, *right[::-1], *back], len(left) + 1 + len(right))
    for q in range(1, min(first + second, len(right)) + 1):  # at least q words from the border on
        to = border + q + (ahead[q] if q < len(right) else 0)
        start = border - behind[len(left) + 1 + len(right) - q]
        if to - start >= max(least, 2 * q) and to <= after and (start > low or not low):
            yield start, to, q
    for q in range(1, min(first + second, len(left)) + 1):  # at least q words before it
        start = border - q - (behind[q] if q < len(left) else 0)
        to = border + ahead[len(right) + 1 + len(left) - q]
        if to - start >= max(least, 2 * q) and to <= after and (start > low or not low):
            yield start, to, q


def runs_of(word: list[int], least: int = LEAST) -> list[tuple[int, int, int]]:
    """start, length, smallest period of all runs, ascending by start and period; word: numbers of 0 or more."""
    if not word:
        return []
    cut = factors(word)
    found: list[dict[int, int]] = [{} for _ in word]  # by start: end -> smallest period
    for (before, _, _), (border, size, _) in zip(cut, [*cut[1:], (len(word), 0, -1)], strict=True):
        for start, end, q in at_border(word, before, border, border + size, least):
            found[start][end] = min(q, found[start].get(end, q))
    for start, size, earlier in cut:
        if earlier < 0 or size < least + 2:
            continue
        for s in range(earlier + 1, earlier + size - least):
            for end, q in found[s].items():
                if end < earlier + size:
                    found[s + start - earlier][end + start - earlier] = q
    return sorted((s, end - s, q) for s, ends in enumerate(found) for end, q in ends.items())


def _run_batches(least: int):
    size = (least + 1) // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, runs, texts = [], [], []
            for value in batch.column(1):
                words = (value.as_py() or b"").split()  # splits at \x20 and \x09 to \x0D
                counts.append(len(words))
                own = []
                if len(words) >= least:
                    ids = np.fromiter(map({}.setdefault, words, count()), np.int64, len(words))
                    for s, e in pieces(ids, size):
                        own += [(s + start, length, q) for start, length, q in runs_of(ids[s:e].tolist(), least)]
                runs.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in own])
                if own:
                    gone = np.zeros(len(words) + 1, np.int64)
                    for start, length, q in own:
                        gone[start + q] += 1
                        gone[start + length] -= 1
                    words = [words[i] for i in np.flatnonzero(np.cumsum(gone)[:-1] == 0)]
                texts.append(b" ".join(words))
            arrays = [batch.column(0), pa.array(counts, pa.int64()), pa.array(runs, pa.list_(RUN)), pa.array(texts, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_words", "runs", "collapsed"])
            batch = None
            trim_memory()

    return run


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """doc_id, n_words, runs (structs of start, length, period by start, then period), collapsed text of each row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return small_batches(rows).mapInArrow(_run_batches(least), f"doc_id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def with_period(text: Column, doc_id: Column) -> Column:
    """The text, but of every tenth id (by CRC-32 of its digits) made periodic from a word on."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeated(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        turned = bound(F.struct(a.alias("a"), p.alias("p")), lambda c: F.transform(words, lambda w, i: F.when(i >= c["a"], F.get(words, (c["a"] + (i - c["a"]) % c["p"]).cast("int"))).otherwise(w)))
        return F.when(n > 0, F.array_join(turned, " ")).otherwise("")

    split = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return F.when(h % 10 == 0, bound(split, repeated)).otherwise(text)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", with_period(F.coalesce("text", F.lit("")), F.col("doc_id")).alias("text"))
    greatest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    found = periodic_runs(docs).select("doc_id", F.size("runs").cast("long").alias("n_runs"), greatest.alias("top"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    top = F.col("top")
    exponent = F.floor(1000 * top["length"] / -top["p"])
    return found.select("doc_id", "n_runs", (-top["s"]).alias("start"), top["length"].alias("length"), (-top["p"]).alias("period"), exponent.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


SQL = """
WITH h AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda a, c: list_reduce([xor(a, c), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) AS h
  FROM documents),
p AS (SELECT r, doc_id, w, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS turned, (h // 10) % greatest(len(w), 1) AS a, 1 + (len(w) - (h // 10) % greatest(len(w), 1)) // (3 + (h // 10) % 8) AS p FROM h),
i AS (SELECT *, unnest(range(n)) AS i FROM p),
t AS (SELECT r, i, w[1 + CASE WHEN turned AND i >= a THEN a + (i - a) % p ELSE i END] AS word FROM i),
k AS (SELECT r, i, word, array_agg(word) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) AS g FROM t),
m AS (SELECT x.r, x.i, y.i - x.i AS q FROM k x JOIN k y ON x.r = y.r AND x.g = y.g AND x.i < y.i WHERE len(x.g) = 6),
s AS (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM m),
e AS (SELECT r, q, min(i) AS s, max(i) + 6 + q AS e FROM s GROUP BY r, q, island),
f AS (SELECT r, s, e, min(q) AS q FROM e WHERE e - s >= greatest(12, 2 * q) GROUP BY r, s, e),
g AS (SELECT r, count(*) AS n_runs, arg_min({'s': s, 'l': e - s, 'q': q}, {'l': s - e, 's': s, 'q': q}) AS top, string_agg(concat(s, ',', e - s, ',', q, chr(10)), '' ORDER BY s, q) AS lines FROM f GROUP BY r),
d AS (SELECT DISTINCT r, unnest(range(s + q, e)) AS i FROM f),
c AS (SELECT t.r, string_agg(t.word, ' ' ORDER BY t.i) AS kept FROM t ANTI JOIN d ON d.r = t.r AND d.i = t.i GROUP BY t.r)
SELECT p.doc_id, coalesce(g.n_runs, 0) AS n_runs, g.top.s AS start, g.top.l AS length, g.top.q AS period, 1000 * g.top.l // g.top.q AS exponent_milli, sha256(coalesce(g.lines, '')) AS runs_sha256, sha256(coalesce(c.kept, '')) AS collapsed_sha256
FROM p LEFT JOIN g ON g.r = p.r LEFT JOIN c ON c.r = p.r
"""
