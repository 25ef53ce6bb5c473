"""Byte-level BPE encoding and decoding by a merge replay over the corpus's words.

Three steps. Documents are cut into words (the matches of the tokenizer's pattern)
and written as numbers into the vocabulary of their block, a stretch of
documents with at most about BLOCK_WORDS different words or BLOCK_CHARS characters.
The words of all vocabularies are dealt to buckets by hash; a bucket's different words,
each once in the corpus, are laid out in an array of
tokens with an inverted index from the rank of a token pair to the positions where the
pair stands: ranks are taken lowest first, all positions of a rank are merged from
left to right, and only the two neighbours of each merge enter the index anew. Last,
the ids of a block's words return to the block, and its documents' numbers are looked
up in them.

A word that every document holds is replayed once and returns once a block. Words
don't influence each other, so buckets can be replayed apart; their number follows the
vocabularies, at about REPLAYED words each. What a task holds is one block or one bucket;
words travel in arrays, one row for a block and a bucket. Documents don't travel: their
numbers are written in files bucketed by block, to which the words return. The vocabulary of tokens (under
1 MB) goes out with the functions.

Defined cases: null text counts as empty; empty texts have no ids and decode to
nothing; a text of any length is in one block whole; repeated rows repeat their
result; an empty table gives no rows; columns other than the id and the text are
not read.
"""

from __future__ import annotations

import base64
import heapq
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.store import bucketed, small_batches, trim_memory

#: Different words and characters of a block's documents, words dealt to a bucket, and the most tasks that buckets go to.
BLOCK_WORDS, BLOCK_CHARS, REPLAYED, MOST_TASKS = 400_000, 12 << 20, 50_000, 10_000

#: Unicode's White_Space, which \s means to the tokenizer; Python's \s has U+001C to U+001F besides.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Letters and numbers among the code points below U+0250, for the built-in, faster regex engine.
LOW_LETTERS, LOW_NUMBERS = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", r"0-9\xb2\xb3\xb9\xbc-\xbe"


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def exact_space(pattern: str) -> str:
    """The pattern with \\s and \\S spelled out, also inside classes."""
    out, inside, i = [], False, 0
    while i < len(pattern):
        two = pattern[i : i + 2]
        if two in (r"\s", r"\S"):
            out.append(WHITE if inside and two == r"\s" else f"[{'^' * (two == chr(92) + 'S')}{WHITE}]")
            i += 2
        elif two[0] == "\\":
            out.append(two)
            i += 2
        else:
            inside = two[0] == "[" or inside and two[0] != "]"
            out.append(two[0])
            i += 1
    return "".join(out)


class MergeReplay:
    """Encodes words by replaying merges over all of them at once."""

    #: Positions of one rank from which they are merged as arrays; fewer cost less one by one.
    MANY = 40

    def __init__(self, ranks: dict[bytes, int]):
        self.tokens: list[bytes] = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.ranks = ranks
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.double = np.array([ranks.get(bytes([a, b]), -1) for a in range(256) for b in range(256)], np.int32)
        self.pairs: dict[int, int] = {}

    def rank_of(self, a: int, b: int) -> int:
        """Rank of the token that a and b make, or -1."""
        key = a << 32 | b
        rank = self.pairs.get(key)
        if rank is None:
            if len(self.pairs) > 60_000:
                self.pairs.clear()
            rank = self.pairs[key] = self.ranks.get(self.tokens[a] + self.tokens[b], -1)
        return rank

    def encode(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word, packed as little-endian unsigned 32-bit integers."""
        state = _Replay(self, words)
        while state.todo:
            rank = heapq.heappop(state.todo)
            places = state.index.pop(rank, None)
            if places is None:
                continue
            if len(places) == 1 and isinstance(places[0], int):
                state.merge_one(rank, places[0])
            else:
                state.merge(rank, places)
        return state.packed()


class _Replay:
    """The words of a block in one array of tokens, linked, with the inverted index from ranks to positions.

    token is -1 between words and -2 where a merge has taken a token away; pair
    holds the rank of the pair that begins at a position, or -1. Of many positions of
    a rank each word merges its leftmost; the others wait, as the pair that the merge
    makes may come before them. Few go one by one, until that happens.
    """

    def __init__(self, owner: MergeReplay, words: list[bytes]):
        self.rank_of = owner.rank_of
        self.lengths = np.fromiter(map(len, words), np.int64, len(words))
        self.ends = np.cumsum(self.lengths + 1)  # of each word's closing mark; a mark stands at 0 too
        laid = np.frombuffer(b"\0" + b"\0".join(words) + b"\0" * bool(words), np.uint8)
        n = len(laid)
        token = owner.single[laid]
        token[0] = -1
        token[self.ends] = -1
        pair = np.full(n, -1, np.int32)
        inside = (token[:-1] >= 0) & (token[1:] >= 0)
        pair[:-1][inside] = owner.double[(laid[:-1].astype(np.int32) << 8 | laid[1:])[inside]]
        # arrays for single positions, views of the same memory for many
        self.token_, self.pair_ = array("i", token.tobytes()), array("i", pair.tobytes())
        self.after_, self.before_ = array("i", np.arange(1, n + 1, dtype=np.int32).tobytes()), array("i", np.arange(-1, n - 1, dtype=np.int32).tobytes())
        self.token, self.pair, self.after, self.before = (np.frombuffer(x, np.int32) for x in (self.token_, self.pair_, self.after_, self.before_))
        self.index: dict[int, list] = {}
        self.todo: list[int] = []
        at = np.flatnonzero(pair >= 0).astype(np.int32)
        self.enter(at, pair[at])

    def put(self, rank: int, place) -> None:
        if rank in self.index:
            self.index[rank].append(place)
        else:
            self.index[rank] = [place]
            heapq.heappush(self.todo, rank)

    def enter(self, at: np.ndarray, ranks: np.ndarray) -> None:
        """Put positions under their ranks, without those of rank -1."""
        at, ranks = at[ranks >= 0], ranks[ranks >= 0]
        if len(at):
            order = np.argsort(ranks, kind="stable")
            at, ranks = at[order], ranks[order]
            cuts = np.concatenate(([0], np.flatnonzero(ranks[1:] != ranks[:-1]) + 1, [len(at)])).tolist()
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                self.put(int(ranks[i]), at[i:j] if j - i > 1 else int(at[i]))

    def merge_one(self, rank: int, at: int) -> bool:
        """Whether a pair came up that goes before the other positions of this rank."""
        token, after, pair = self.token_, self.after_, self.pair_
        if pair[at] != rank:
            return False  # a neighbour was merged meanwhile
        gone = after[at]
        beyond, behind = after[gone], self.before_[at]
        token[at], token[gone], pair[gone] = rank, -2, -1
        after[at], self.before_[beyond] = beyond, at
        x, y = token[behind], token[beyond]
        lower = False
        if x >= 0:
            made = pair[behind] = self.rank_of(x, rank)
            if made >= 0:
                lower = made <= rank
                self.put(made, behind)
        made = pair[at] = self.rank_of(rank, y) if y >= 0 else -1
        if made >= 0:
            lower |= made <= rank
            self.put(made, at)
        return lower

    def merge(self, rank: int, places: list) -> None:
        if sum(1 if isinstance(p, int) else len(p) for p in places) < MergeReplay.MANY:
            few = sorted({x for p in places for x in ((p,) if isinstance(p, int) else p.tolist())})
            for k, one in enumerate(few):
                if self.merge_one(rank, one) and few[k + 1 :]:
                    self.put(rank, np.array(few[k + 1 :], np.int32))
                    return
            return
        at = np.concatenate([np.atleast_1d(np.asarray(p, np.int32)) for p in places]) if len(places) > 1 else places[0]
        at = np.unique(at[self.pair[at] == rank])
        if not len(at):
            return
        word = np.searchsorted(self.ends, at)
        first = np.concatenate(([True], word[1:] != word[:-1]))
        rest, at = at[~first], at[first]
        if len(rest):
            self.put(rank, rest)
        gone = self.after[at]
        beyond, behind = self.after[gone], self.before[at]
        self.token[at], self.token[gone], self.pair[gone] = rank, -2, -1
        self.after[at], self.before[beyond] = beyond, at
        for here, other, left in ((behind, behind, True), (at, beyond, False)):
            near = self.token[other]
            kinds, which = np.unique(near, return_inverse=True)
            made = np.array([-1 if t < 0 else self.rank_of(t, rank) if left else self.rank_of(rank, t) for t in kinds.tolist()], np.int32)[which]
            self.pair[here[near >= 0] if left else here] = made[near >= 0] if left else made
            self.enter(here, made)

    def packed(self) -> list[bytes]:
        stays = self.token >= 0
        upto = np.concatenate(([0], np.cumsum(stays))) * 4
        blob = self.token[stays].astype("<u4").tobytes()
        from_, to = upto[self.ends - self.lengths].tolist(), upto[self.ends].tolist()
        return [blob[a:b] for a, b in zip(from_, to, strict=True)]


def splitter(pattern: str) -> Callable[[str], list[str]]:
    """All matches of the pattern in a text."""
    import re

    exact = exact_space(pattern)
    full = regex.compile(exact)
    low = exact.replace(r"\p{L}", "\0L").replace(r"\p{N}", "\0N")
    parts, inside, i = [], False, 0
    while i < len(low):
        c = low[i]
        if c == "\0":
            known = LOW_LETTERS if low[i + 1] == "L" else LOW_NUMBERS
            parts.append(known if inside else f"[{known}]")
            i += 2
            continue
        if c == "\\":
            parts.append(low[i : i + 2])
            i += 2
            continue
        inside = c == "[" or inside and c != "]"
        parts.append(c)
        i += 1
    if r"\p" in exact.replace(r"\p{L}", "").replace(r"\p{N}", "") or "(?i" in exact:
        return full.findall
    fast, high = re.compile("".join(parts)), re.compile(r"[^\x00-\u024f]").search
    return lambda text: full.findall(text) if high(text) else fast.findall(text)


def planes(numbers: np.ndarray) -> bytes:
    """Numbers of 32 bits as their lowest bytes, then the next ones and so on: mostly zeros at the end, which compress."""
    return np.ascontiguousarray(numbers.astype("<u4").view("u1").reshape(-1, 4).T).tobytes()


def numbers_of(blob: pa.Buffer | None) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(blob or b"", "u1").reshape(4, -1).T).view("<u4").ravel()


def packed(words: list[bytes]) -> bytes:
    """Words end to end behind their number and lengths."""
    return b"".join([len(words).to_bytes(8, "little"), planes(np.fromiter(map(len, words), "<u4", len(words))), *words])


def unpacked(blob: bytes) -> list[bytes]:
    n = int.from_bytes(blob[:8], "little")
    ends = (8 + 4 * n + np.cumsum(numbers_of(blob[8 : 8 + 4 * n]), dtype=np.int64)).tolist()
    return [blob[a:b] for a, b in zip([8 + 4 * n, *ends], ends, strict=False)]


CUT = ["block", "doc_id", "words", "n", "vocabulary"]


def cut_batches(pattern: str, block_words: int, block_chars: int):
    """Rows (block, doc_id, words as numbers), and after a block's documents one (block, n, vocabulary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, kind = splitter(pattern), None
        first = TaskContext.get().partitionId() << 33
        block, chars, vocabulary = 0, 0, {}

        def closed() -> pa.RecordBatch:
            words = [w.encode() for w in vocabulary]
            columns = [pa.array([first + block], pa.int64()), pa.nulls(1, kind), pa.nulls(1, pa.binary()), pa.array([len(words)], pa.int64()), pa.array([packed(words)], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=CUT)

        for batch in batches:
            kind, numbers, start = batch.schema.types[0], [], 0

            def cut(upto: int) -> pa.RecordBatch:
                n = len(numbers)
                return pa.RecordBatch.from_arrays([pa.array([first + block] * n, pa.int64()), batch.column(0).slice(upto - n, n), pa.array(numbers, pa.binary()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())], names=CUT)

            for i, text in enumerate(batch.column(1)):
                text = text.as_py() or ""
                words = split(text)
                for w in set(words).difference(vocabulary):
                    vocabulary[w] = len(vocabulary)
                numbers.append(planes(np.fromiter(map(vocabulary.__getitem__, words), "<u4", len(words))))
                chars += len(text)
                if len(vocabulary) >= block_words or chars >= block_chars:
                    yield cut(i + 1)
                    yield closed()
                    block, chars, numbers, vocabulary = block + 1, 0, [], {}
            yield cut(batch.num_rows)
        if vocabulary:
            yield closed()
        vocabulary = {}
        trim_memory()

    return run


def deal_batches(buckets: int):
    """Rows (bucket, of, at, words): the vocabulary of block `of` by bucket, at being the steps between the words' numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for of, words in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = unpacked(words.as_py())
                bucket = np.fromiter((xxhash.xxh3_64_intdigest(w) % buckets for w in words), np.int64, len(words))
                order = np.argsort(bucket, kind="stable")
                there, cuts = np.unique(bucket[order], return_index=True)
                parts = np.split(order, cuts[1:])
                at = [planes(np.diff(p, prepend=0)) for p in parts]
                yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array([of] * len(there), pa.int64()), pa.array(at, pa.binary()), pa.array([packed([words[i] for i in p.tolist()]) for p in parts], pa.binary())], names=["bucket", "of", "at", "words"])

    return run


def _replayed(ranks: dict[bytes, int]):
    """A bucket's rows (of, at, words) as (of, at, ids, sizes): the ids of the words, end to end, and how many each has."""

    def run(table: pa.Table) -> pa.Table:
        known: dict[bytes, int] = {}
        mine = [np.array([known.setdefault(w, len(known)) for w in unpacked(x.as_py())], np.int64) for x in table.column("words")]
        flat, starts, sizes = _laid(MergeReplay(ranks).encode(list(known)), "<u4")
        ids = [planes(np.frombuffer(_gathered(flat, starts, sizes, m), "<u4")) for m in mine]
        size = [planes(sizes[m]) for m in mine]
        known = {}
        trim_memory()
        return pa.table({"of": table.column("of"), "at": table.column("at"), "ids": pa.array(ids, pa.binary()), "sizes": pa.array(size, pa.binary())})

    return run


def _gathered(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, at: np.ndarray) -> bytes:
    """The stretches at[0], at[1] ... of flat, one after another."""
    n = sizes[at]
    upto = np.cumsum(n)
    return flat[np.repeat(starts[at] - (upto - n), n) + np.arange(upto[-1] if len(at) else 0)].tobytes()


def _laid(parts: list[bytes], kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // np.dtype(kind).itemsize
    return np.frombuffer(b"".join(parts), kind), np.cumsum(sizes) - sizes, sizes


def _looked_up(docs: pa.Table, words: pa.Table) -> pa.Table:
    """doc_id, ids of a block's documents, from the rows (at, ids, sizes) of all buckets that its vocabulary went to."""
    at = np.concatenate([np.zeros(0, np.int64), *(np.cumsum(numbers_of(x.as_buffer()), dtype=np.int64) for x in words.column("at"))])
    size = np.concatenate([np.zeros(0, np.int64), *(numbers_of(x.as_buffer()).astype(np.int64) for x in words.column("sizes"))])
    flat = np.concatenate([np.zeros(0, np.uint32), *(numbers_of(x.as_buffer()) for x in words.column("ids"))])
    starts, sizes = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    starts[at], sizes[at] = np.cumsum(size) - size, size
    ids = [_gathered(flat, starts, sizes, numbers_of(x.as_buffer())) for x in docs.column("words")]
    return pa.table({"doc_id": docs.column("doc_id"), "ids": pa.array(ids, pa.binary())})


def decode_batches(tokens: list[bytes]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat, starts, sizes = _laid(tokens, "u1")
        for batch in batches:
            decoded = [_gathered(flat, starts, sizes, np.frombuffer(x.as_buffer() or b"", "<u4")) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(decoded, pa.binary())], names=["doc_id", "ids", "decoded"])
            decoded = batch = None
            trim_memory()

    return run


def encoded(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text", block_words: int = BLOCK_WORDS, block_chars: int = BLOCK_CHARS, replayed: int = REPLAYED) -> DataFrame:
    """doc_id, ids (token ids as little-endian unsigned 32-bit integers)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = small_batches(rows).mapInArrow(cut_batches(pattern, block_words, block_chars), f"block long, doc_id {kind}, words binary, n long, vocabulary binary")
    cut = bucketed(cut, "words", "block", n)
    words = cut.where("n is not null").select(F.col("block").alias("of"), "n", "vocabulary")
    buckets = max(1, -(-words.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] // replayed))
    dealt = words.select("of", "vocabulary").mapInArrow(deal_batches(buckets), "bucket int, of long, at binary, words binary")
    back = dealt.repartition(min(buckets, MOST_TASKS), "bucket").groupBy("bucket").applyInArrow(_replayed(ranks), "of long, at binary, ids binary, sizes binary")
    numbers = cut.where("words is not null").select("block", "doc_id", "words")
    looked_up = numbers.where("octet_length(words) > 0").groupBy("block").cogroup(back.repartition(n, "of").groupBy("of")).applyInArrow(_looked_up, f"doc_id {kind}, ids binary")
    return looked_up.unionAll(numbers.where("octet_length(words) = 0").select("doc_id", F.col("words").alias("ids")))


def decoded(ids: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """doc_id, ids, decoded (the bytes the ids stand for) from the output of encoded()."""
    tokens = MergeReplay(ranks).tokens
    return ids.mapInArrow(decode_batches(tokens), f"doc_id {ids.schema['doc_id'].dataType.simpleString()}, ids binary, decoded binary")


def digests(docs: DataFrame, **sizes: int) -> DataFrame:
    import public_tokenizers

    ranks = load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    both = decoded(encoded(docs, ranks, public_tokenizers.PATTERN, **sizes), ranks)
    return both.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def query(spark, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
