"""Embedding near-dedup: inverted lists, residual product codes, exact cosine.

A bounded sample (SAMPLE vectors by hash of their values) trains the coarse
quantiser and, on the residuals, one codebook for each of SUBSPACES subspaces;
every vector is indexed. The quantiser has two levels, as many centroids as the
sample can place (at most COARSE) and, where the vectors are more than these
serve, sums of a centroid and one of the refinements shared by all: the number of
lists grows with the vectors at LIST_ROWS each.

A vector visits the lists whose border with its own list is nearer than the
margin. Two vectors at distance e lie on opposite sides of the border between
their lists, and the parts of their difference across the border are together at
most e times the share of the difference that points across. That share is
measured on the sample, against the borders near a vector, on the vectors that it links
with, the PARTNERS farthest of them, as these differ along what spreads the data and not along its noise (a pair
nearer than e counts for as much less); only a vector without links in the sample is held against its
nearest neighbour. The margin is e/2 times the largest share met. Where links differ along few
directions, as in data of low rank with or without noise, it is the exact e/2; where they differ in
many, it is a fraction of it. A pair is missed where its share exceeds every one of the sample;
tests measure how many (recall of 0.99 or more at the threshold).

Inside a list, distances of q to members come from lookup tables of its
residual against the codebooks. A member is reranked when its coded distance
is at most e plus the member's own coding error, which loses no pair. The
rerank is the cosine of the stored vectors in double precision.

Equal vectors are one node with a count. A list's members are split into blocks
of about BLOCK, its visitors into parts of about VISITORS, and each block meets
each part in a group of its own; links are counted where they are found and
leave a group only as sums and one edge a vector.

Defined cases: null and zero vectors and those with null or non-finite
components link with nothing, nor do vectors of different lengths; finite ones
link whatever their scale; rows that
repeat a vec_id count as vectors of their own but are one node to the
components; a null vec_id is never a component's name; an empty table gives no
rows; columns other than the id and the vector are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.components import connected_components
from palisade.llm.store import small_enough, written

THRESHOLD = 0.9
SAMPLE, SAMPLE_BYTES, LIST_ROWS, COARSE, BLOCK, VISITORS = 40_000, 64 << 20, 256, 4096, 2048, 8192
SUBSPACES, CODES, ROUNDS, SEED = 8, 256, 8, 3
#: Vectors that shares are measured on, and linked vectors and borders of each.
MEASURED, PARTNERS, BORDERS = 2000, 4, 8
#: Entries of a matrix of distances that are held at once.
ENTRIES = 1 << 20


def _clean_batches(kind: str):
    """Valid vectors as bytes of their stored type, with their length and a digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs, sizes, digests = [], [], []
            for x in batch.column(1):
                blob = None
                if x.is_valid and not x.values.null_count and len(x.values):
                    v = np.asarray(x.values.to_numpy(zero_copy_only=False), kind) + 0.0  # -0.0 becomes 0.0
                    blob = v.tobytes() if np.isfinite(v).all() and v.any() else None
                blobs.append(blob)
                sizes.append(len(blob) // np.dtype(kind).itemsize if blob else 0)
                digests.append(xxhash.xxh3_128_digest(blob) if blob else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int32()), pa.array(digests, pa.binary()), pa.array(blobs, pa.binary())], names=["vec_id", "size", "digest", "v"])

    return run


def unit(blobs: list[bytes], kind: str, width: int) -> np.ndarray:
    """Vectors as rows of length one in double precision, short ones filled with zeros."""
    out = np.zeros((len(blobs), width))
    if all(len(b) == width * np.dtype(kind).itemsize for b in blobs):
        out[:] = np.frombuffer(b"".join(blobs), kind).reshape(-1, width)
    else:
        for row, blob in zip(out, blobs, strict=True):
            v = np.frombuffer(blob, kind)
            row[: len(v)] = v
    out /= np.abs(out).max(1, keepdims=True)  # squares of the parts neither overflow nor vanish
    out /= np.linalg.norm(out, axis=1, keepdims=True)
    return out


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1) - 2 * (x @ y.T), 0)


def nearest(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    step = max(1, ENTRIES // len(y))
    return np.concatenate([squared(x[i : i + step], y).argmin(1) for i in range(0, len(x), step)]) if len(x) else np.zeros(0, int)


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    centres = x[rng.permutation(len(x))[: min(k, len(x))]].copy()
    for _ in range(ROUNDS):
        own = nearest(x, centres)
        count = np.bincount(own, minlength=len(centres))
        sums = np.stack([np.bincount(own, x[:, j], len(centres)) for j in range(x.shape[1])], 1)
        centres[count > 0] = sums[count > 0] / count[count > 0, None]
    return centres


class ProductIndex:
    """The lists' centres, each a coarse centroid plus a refinement, and the codebooks of residuals; at most a few MB."""

    def __init__(self, coarse: np.ndarray, fine: np.ndarray, threshold: float):
        self.coarse, self.fine = coarse, fine
        self.reach = float(np.sqrt(2 - 2 * threshold)) + 1e-6
        self.norms = (coarse * coarse).sum(1)[:, None] + (fine * fine).sum(1) + 2 * coarse @ fine.T
        self.margin = self.reach / 2
        self.books: list[np.ndarray] = []
        self.parts: list[np.ndarray] = []

    @classmethod
    def fitted(cls, sample: np.ndarray, n: int, threshold: float, coarse: int = COARSE) -> ProductIndex:
        rng = np.random.default_rng(SEED)
        k = max(1, min(n // LIST_ROWS, coarse, len(sample) // 8))
        centres = kmeans(sample, k, rng)
        refined = min(n // (LIST_ROWS * k), len(sample) // 8)
        fine = kmeans(sample - centres[nearest(sample, centres)], refined, rng) if refined > 1 else np.zeros((1, sample.shape[1]))
        made = cls(centres, fine, threshold)
        home = made.homes(sample)
        rest = sample - made.centres(home)
        made.parts = [p for p in np.array_split(np.arange(sample.shape[1]), min(SUBSPACES, sample.shape[1])) if len(p)]
        made.books = [kmeans(rest[:, p], CODES, rng) for p in made.parts]
        made.margin *= made.across(sample)
        return made

    def centres(self, lists: np.ndarray) -> np.ndarray:
        return self.coarse[lists // len(self.fine)] + self.fine[lists % len(self.fine)]

    def away(self, x: np.ndarray) -> np.ndarray:
        """Squared distances to all lists' centres, less the square of x's own length."""
        both = (x @ self.coarse.T)[:, :, None] + (x @ self.fine.T)[:, None, :]
        return (self.norms - 2 * both).reshape(len(x), -1)

    def chunks(self, n: int) -> Iterator[slice]:
        step = max(1, ENTRIES // self.norms.size)
        return (slice(i, i + step) for i in range(0, n, step))

    def homes(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.int64), *(self.away(x[c]).argmin(1) for c in self.chunks(len(x)))]).astype(np.int64)

    def across(self, sample: np.ndarray) -> float:
        """The largest share of e that the difference of linked (without any: of near) vectors has across borders near them; at most 1."""
        if self.norms.size < 2 or len(sample) < 2:
            return 1.0
        most = 0.0
        for at in range(0, min(MEASURED, len(sample)), step := max(1, ENTRIES // max(len(sample), self.norms.size))):
            x = sample[at : min(at + step, MEASURED)]
            d = squared(x, sample)
            d[d < 1e-9] = np.inf  # itself and its copies
            linked = np.where(d <= self.reach**2, d, -1.0)
            partners = np.argsort(-linked, 1)[:, :PARTNERS]
            far = np.take_along_axis(linked, partners, 1)
            partners[:, 0] = np.where(far[:, 0] < 0, d.argmin(1), partners[:, 0])
            u = x[:, None] - sample[partners]
            length = np.maximum(np.linalg.norm(u, axis=2), 1e-12)
            weight = np.where(far < 0, 0.0, np.minimum(1.0, length / self.reach))
            weight[far[:, 0] < 0, 0] = 1.0
            away = self.away(x)
            lists = np.argsort(away, 1)[:, : BORDERS + 1]
            normal = self.centres(lists[:, 1:].ravel()).reshape(len(x), -1, x.shape[1]) - self.centres(lists[:, 0])[:, None]
            normal /= np.maximum(np.linalg.norm(normal, axis=2, keepdims=True), 1e-12)
            shares = np.abs(np.einsum("ikd,ipd->ipk", normal, u / length[:, :, None])) * weight[:, :, None]
            most = max(most, float(shares.max()))
        return min(1.0, most)

    def coded(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
        """Home list, codes, coding error and other lists visited of each row."""
        home, probes = np.zeros(len(x), np.int64), []
        for c in self.chunks(len(x)):
            away = self.away(x[c])
            home[c] = here = away.argmin(1)
            away -= away[np.arange(len(here)), here][:, None]
            own = self.centres(here)
            apart = np.sqrt(np.maximum(self.away(own) + (own * own).sum(1)[:, None], 0))
            near = away <= 2 * self.margin * apart + 1e-9
            near[np.arange(len(here)), here] = False
            row, other = np.nonzero(near)
            probes += np.split(other, np.searchsorted(row, np.arange(1, len(here))))
        rest = x - self.centres(home)
        codes = np.stack([nearest(rest[:, p], book) for p, book in zip(self.parts, self.books, strict=True)], 1).astype(np.uint8)
        error = sum(((rest[:, p] - book[codes[:, k]]) ** 2).sum(1) for k, (p, book) in enumerate(zip(self.parts, self.books, strict=True)))
        return home, codes, np.sqrt(error), probes

    def distances(self, x: np.ndarray, centre: int, codes: np.ndarray) -> np.ndarray:
        """Asymmetric: the coded members of a list to rows of x, squared, by table lookup."""
        rest = x - self.centres(np.array([centre]))
        out = np.zeros((len(codes), len(x)), np.float32)
        for k, (p, book) in enumerate(zip(self.parts, self.books, strict=True)):
            out += squared(book, rest[:, p]).astype(np.float32)[codes[:, k]]
        return out


def _code_batches(index: ProductIndex, kind: str, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = unit(batch.column(3).to_pylist(), kind, width)
            home, codes, error, probes = index.coded(x)
            columns = [pa.array(home, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error), pa.array([p.astype(np.int32) for p in probes], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, "home", "codes", "error", "probes"])

    return run


def _search_block(index: ProductIndex, kind: str, width: int, threshold: float):
    def run(key, table):
        centre = key[0].as_py()
        rows = {c: np.asarray(table.column(c).to_pylist(), d) for c, d in (("vec_id", np.int64), ("n", np.int64), ("size", np.int64), ("home", np.int64), ("visits", bool))}
        x = unit(table.column("v").to_pylist(), kind, width)
        member, visit = np.flatnonzero(~rows["visits"]), np.flatnonzero(rows["visits"])
        ids, n, home, probes = rows["vec_id"], rows["n"], rows["home"], table.column("probes").to_pylist()
        links = np.zeros(len(ids), np.int64)
        root = np.arange(len(ids))
        edges = []
        if len(member) and len(visit):
            codes = np.frombuffer(b"".join(table.column("codes").take(pa.array(member)).to_pylist()), np.uint8).reshape(len(member), -1)
            reach = (index.reach + np.asarray(table.column("error").take(pa.array(member)).to_pylist())) ** 2 + 1e-5  # tables are of single precision
            asks = {}  # members that visit a list themselves
            for i, m in enumerate(member):
                for p in probes[m]:
                    asks.setdefault(p, []).append(i)
            for at in range(0, len(visit), 512):
                q = visit[at : at + 512]
                b, a = np.nonzero(index.distances(x[q], centre, codes) <= reach[:, None])
                q, m = q[a], member[b]
                for cut in range(0, len(q), 100_000):
                    s, t = q[cut : cut + 100_000], m[cut : cut + 100_000]
                    ok = (np.einsum("ij,ij->i", x[s], x[t]) >= threshold) & (ids[s] != ids[t]) & (rows["size"][s] == rows["size"][t])
                    s, t = s[ok], t[ok]
                    inside = home[s] == centre
                    np.add.at(links, s[inside], n[t[inside]])
                    s2, t2 = s[~inside], t[~inside]
                    if len(s2):  # a pair across lists counts in the lower list if both ends visit the other
                        back = {h: set(member[asks.get(int(h), [])].tolist()) for h in np.unique(home[s2])}
                        here = np.array([not (h < centre and int(j) in back[h]) for h, j in zip(home[s2], t2, strict=True)])
                        np.add.at(links, s2[here], n[t2[here]])
                        np.add.at(links, t2[here], n[s2[here]])
                    edges.append((s, t))
        if edges:
            s, t = (np.concatenate(e) for e in zip(*edges, strict=True))
            while True:
                low = root.copy()
                np.minimum.at(low, s, low[t])
                np.minimum.at(low, t, low[s])
                low = np.minimum(low, low[low])
                if (low == root).all():
                    break
                root = low
        out = np.flatnonzero((links > 0) | (root != np.arange(len(ids))))
        return pa.table({"vec_id": pa.array(ids[out]), "links": pa.array(links[out]), "root": pa.array(ids[root[out]])})

    return run


def near_vectors(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept of each row."""
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("embedding"))
    kind = "<f4" if rows.schema["embedding"].dataType.elementType.simpleString() == "float" else "<f8"
    if kind == "<f8":
        rows = rows.withColumn("embedding", F.col("embedding").cast("array<double>"))
    clean = written(rows.mapInArrow(_clean_batches(kind), "vec_id long, size int, digest binary, v binary"), "vectors")
    valid = clean.where("digest is not null and vec_id is not null")
    nodes = written(valid.groupBy("digest", "v", "size").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("n")), "nodes")
    n, width = nodes.agg(F.count("*"), F.coalesce(F.max("size"), F.lit(0))).first()
    found = _linked(nodes, n, width, kind, threshold) if n else None
    names = nodes.select("digest", F.col("vec_id").alias("rep"), "n")
    out = clean.join(written(names, "names"), "digest", "left")
    if found is None:
        out = out.withColumns({"links": F.lit(None).cast("long"), "component": F.lit(None).cast("long")})
    else:
        out = out.join(found, "rep", "left")
    n_links = F.coalesce("links", F.lit(0).cast("long")) + F.coalesce(F.col("n") - 1, F.lit(0).cast("long"))
    return out.select("vec_id", n_links.alias("n_links"), F.coalesce("component", "rep", "vec_id").alias("component_id")).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _linked(nodes: DataFrame, n: int, width: int, kind: str, threshold: float) -> DataFrame:
    """rep, links (vectors linked with it, copies of itself not counted), component."""
    size = min(SAMPLE, max(1000, SAMPLE_BYTES // (8 * width)))
    sample = [bytes(r.v) for r in nodes.select("digest", "v").orderBy("digest").limit(size).collect()]  # bounded by SAMPLE rows and SAMPLE_BYTES
    index = ProductIndex.fitted(unit(sample, kind, width), n, threshold)
    coded = nodes.select("vec_id", "n", "size", "v").mapInArrow(_code_batches(index, kind, width), "vec_id long, n long, size int, v binary, home int, codes binary, error double, probes array<int>")
    coded = written(coded, "coded")
    goes = coded.select(F.explode(F.concat(F.array("home"), "probes")).alias("list"), "vec_id", "n", "size", "home", "v")
    blocks = coded.groupBy(F.col("home").alias("list")).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    parts = goes.groupBy("list").agg(F.ceil(F.count("*") / VISITORS).cast("int").alias("parts"))
    cells = written(blocks.join(parts, "list"), "cells")  # one row a list
    cells = F.broadcast(cells) if small_enough(cells) else cells
    at = lambda c: F.pmod(F.xxhash64("vec_id"), F.col(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    member = coded.withColumn("list", F.col("home")).join(cells, "list").select("list", at("blocks").alias("block"), every("parts").alias("part"), F.lit(False).alias("visits"), "vec_id", "n", "size", "home", "codes", "error", "probes", "v")
    none = F.lit(None)
    visits = goes.join(cells, "list").select("list", every("blocks").alias("block"), at("parts").alias("part"), F.lit(True).alias("visits"), "vec_id", "n", "size", "home", none.cast("binary").alias("codes"), none.cast("double").alias("error"), F.array().cast("array<int>").alias("probes"), "v")
    found = member.unionAll(visits).groupBy("list", "block", "part").applyInArrow(_search_block(index, kind, width, threshold), "vec_id long, links long, root long")
    found = written(found, "found")
    links = written(found.groupBy("vec_id").agg(F.sum("links").alias("links")), "links")
    parts = written(connected_components(found, "vec_id", "root"), "vector-components")
    return links.select(F.col("vec_id").alias("rep"), "links").join(parts.select(F.col("id").alias("rep"), "component"), "rep", "full")


def query(spark, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))) AND list_bool_or(list_transform(embedding, lambda x: x <> 0))),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
n AS (SELECT x AS vec_id, count(*) AS n FROM l GROUP BY x),
r AS (SELECT x AS vec_id, x AS root FROM l UNION SELECT l.y, r.root FROM r JOIN l ON l.x = r.vec_id),
c AS (SELECT vec_id, min(root) AS root FROM r GROUP BY vec_id)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, coalesce(c.root, e.vec_id) AS component_id, coalesce(c.root, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN n ON n.vec_id = e.vec_id LEFT JOIN c ON c.vec_id = e.vec_id
"""
