"""Centroid clustering with Elkan's bounds, in exact integers.

Components become floor(scale * x); distances are squared Euclidean in 64-bit
integers, centroids exact floors of sums over counts. Each vector keeps an upper
bound of the distance to its centroid and a lower bound for each of the k centroids.
When centroids have moved, the bounds move by as much, and a vector

* whose upper bound is less than half the distance from its centroid to the nearest
  other one is passed over;
* else has its own distance computed, and that to another centroid only if neither the lower
  bound nor half the distance between the two centroids exceeds the upper bound.

Bounds are of single precision, upper ones rounded up and lower ones down, and a
comparison must be strict to skip a distance: a tie is always computed, and goes to
the smaller number.

The vectors travel with their bounds in a table of the shared folder, one for each
round; the one before is deleted. A round is one pass without a shuffle; what
moved between clusters is summed in each task, then by cluster, and changes the sums that
the driver holds: k * components integers. Rounds end early when no centroid moves, as
further ones would change nothing. Only the k centroids are collected.

Defined cases: vectors that are null, of another length, or with a null or
non-finite component are left out, and so is one with a component so large that
distances might not fit 64 bits (2**27 after scaling at 64 components); rows that
repeat a vec_id are vectors of their own; a null id is clustered but never seeds; of
equal seed hashes the smaller vector comes first; with fewer vectors than k each of them
seeds; an empty table gives no rows; an inertia that does not fit 64 bits is
null; columns other than id and vector are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.store import discard, stored, written

K, ROUNDS, SIZE, SCALE, SALT = 8, 10, 64, 1024, "3:"
STATE = "x binary, cluster int, before int, upper float, lower binary, distance long, computed int"
#: Rows that are computed at once.
ROWS = 8192


def most(size: int) -> int:
    """The largest component for which a squared distance fits 64 bits."""
    return math.isqrt((1 << 62) // max(1, size)) // 2


def _integer_batches(size: int, scale: int):
    limit = most(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, blobs = [], []
            for i, x in enumerate(batch.column(1)):
                if x.is_valid and len(x.values) == size and not x.values.null_count:
                    v = np.asarray(x.values.to_numpy(zero_copy_only=False), np.float64)
                    if np.isfinite(v).all():
                        with np.errstate(over="ignore"):
                            v = np.floor(v * scale)
                        if (np.abs(v) <= limit).all():
                            keep.append(i)
                            blobs.append(v.astype("<i4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), pa.array(blobs, pa.binary())], names=["vec_id", "x"])

    return run


def down(x: np.ndarray) -> np.ndarray:
    return np.maximum(np.nextafter(x.astype(np.float32), np.float32(-np.inf)), np.float32(0))


def up(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x.astype(np.float32), np.float32(np.inf))


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    d = x - y
    return np.einsum("ij,ij->i", d, d)


class Centres:
    """The k centroids of a round, how far each has moved since the one before, and half the distances between them."""

    def __init__(self, at: np.ndarray, before: np.ndarray | None = None):
        self.at = at
        self.moved = None if before is None else up(np.sqrt(squared(at, before)))
        self.halves = np.stack([down(np.sqrt(squared(at, c)) / 2) for c in at])
        np.fill_diagonal(self.halves, np.inf)
        self.near = self.halves.min(1)

    def first(self, x: np.ndarray) -> tuple[np.ndarray, ...]:
        """cluster, upper, lower, distance to the cluster's centroid and number of distances computed of each row."""
        d = np.stack([squared(x, c) for c in self.at], 1)
        own = d.argmin(1)  # the first of equal ones
        best = d[np.arange(len(x)), own]
        return own, up(np.sqrt(best)), down(np.sqrt(d)), best, np.full(len(x), len(self.at))

    def next(self, x: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray, last: bool) -> tuple[np.ndarray, ...]:
        """The same from the bounds of the round before; the distance is -1 where it was not needed, but in the last round."""
        own, upper = own.copy(), up(upper + self.moved[own].astype(np.float64))
        lower = down(lower.astype(np.float64) - self.moved)
        best, computed = np.full(len(x), -1, np.int64), np.zeros(len(x), np.int64)
        passed = upper < self.near[own]
        asks = np.arange(len(x)) if last else np.flatnonzero(~passed)
        best[asks] = squared(x[asks], self.at[own[asks]])
        computed[asks] = 1
        upper[asks] = up(np.sqrt(best[asks]))
        lower[asks, own[asks]] = down(np.sqrt(best[asks]))
        asks = np.flatnonzero(~passed)
        home = own[asks]
        for j in range(len(self.at)):
            rows = asks[(home != j) & ~(upper[asks] < lower[asks, j]) & ~(upper[asks] < self.halves[own[asks], j])]
            if not len(rows):
                continue
            d = squared(x[rows], self.at[j])
            computed[rows] += 1
            lower[rows, j] = down(np.sqrt(d))
            nearer = (d < best[rows]) | ((d == best[rows]) & (j < own[rows]))
            rows, d = rows[nearer], d[nearer]
            own[rows], best[rows], upper[rows] = j, d, up(np.sqrt(d))
        return own, upper, lower, best, computed


def _assign_batches(centres: Centres, last: bool):
    k, size = centres.at.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            x = np.frombuffer(b"".join(batch.column("x").to_pylist()), "<i4").reshape(-1, size).astype(np.int64)
            if centres.moved is None:
                before = np.full(len(x), -1)
                state = centres.first(x)
            else:
                before = batch.column("cluster").to_numpy()
                lower = np.frombuffer(b"".join(batch.column("lower").to_pylist()), "<f4").reshape(-1, k)
                state = centres.next(x, before, batch.column("upper").to_numpy(), lower, last)
            own, upper, lower, best, computed = state
            arrays = [batch.column("vec_id"), batch.column("x"), pa.array(own, pa.int32()), pa.array(before, pa.int32()), pa.array(upper, pa.float32())]
            arrays += [pa.array([row.tobytes() for row in lower.astype("<f4")], pa.binary()), pa.array(best, pa.int64()), pa.array(computed, pa.int32())]
            yield pa.RecordBatch.from_arrays(arrays, names=["vec_id", *(c.split()[0] for c in STATE.split(", "))])

    return run


def _change_batches(k: int, size: int):
    """What each cluster of a task has gained: vectors and sums of their components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros(k, np.int64), np.zeros((k, size), np.int64)
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column(0).to_pylist()), "<i4").reshape(-1, size).astype(np.int64)
            own, before = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for j in range(k):
                for rows, sign in ((own == j, 1), (before == j, -1)):
                    n[j] += sign * int(rows.sum())
                    sums[j] += sign * x[rows].sum(0)
        some = [j for j in range(k) if n[j] or sums[j].any()]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(n[some]), pa.array(sums[some].tolist(), pa.list_(pa.int64()))], names=["cluster", "n", "sums"])

    return run


def changes(state: DataFrame, k: int, size: int) -> dict[int, tuple[int, list[int]]]:
    """Of each cluster that gained or lost vectors: by how many, and by what sums; k rows at most."""
    moved = state.where("cluster <> before").select("x", "cluster", "before").mapInArrow(_change_batches(k, size), "cluster int, n long, sums array<long>")
    total = moved.groupBy("cluster").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n"), *[F.sum(F.get("sums", F.lit(i)).cast("decimal(38,0)")).alias(f"s{i}") for i in range(size)])
    return {r.cluster: (int(r.n), [int(r[f"s{i}"]) for i in range(size)]) for r in total.collect()}


def clustered(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, rounds: int = ROUNDS, size: int = SIZE, scale: int = SCALE, salt: str = SALT) -> tuple[DataFrame, np.ndarray]:
    """vec_id, cluster, distance, computed (distances of the last round) of each vector; the centroids.

    Centroids start as the k vectors with the smallest SHA-256 of salt and id.
    """
    spark = table.sparkSession
    kind = table.select(F.col(id_col)).schema[0].dataType.simpleString()
    rows = table.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    vectors = written(rows.mapInArrow(_integer_batches(size, scale), f"vec_id {kind}, x binary"), "whole-vectors")
    seeds = vectors.where("vec_id is not null").select(F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256).alias("hash"), "x").orderBy("hash", "x").limit(k).collect()
    if not seeds:
        return vectors.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"), F.lit(0).alias("computed")).where("false"), np.zeros((0, size), np.int64)
    centres = Centres(np.stack([np.frombuffer(s.x, "<i4") for s in seeds]).astype(np.int64))
    k, state, path = len(seeds), vectors, None
    n, sums = [0] * k, [[0] * size for _ in range(k)]
    left = rounds
    while True:
        old, path = path, stored(state.mapInArrow(_assign_batches(centres, not left), f"vec_id {kind}, {STATE}"), "clusters")
        state = spark.read.schema(f"vec_id {kind}, {STATE}").parquet(path)
        if old:
            discard(spark, old)
        if not left:
            break
        for j, (more, by) in changes(state, k, size).items():
            n[j] += more
            sums[j] = [a + b for a, b in zip(sums[j], by, strict=True)]
        after = np.array([[s // n[j] for s in sums[j]] if n[j] else centres.at[j].tolist() for j in range(k)], np.int64)
        left = left - 1 if (after != centres.at).any() else 0
        centres = Centres(after, centres.at)
    return state.select("vec_id", "cluster", "distance", "computed"), centres.at


def inertia(found: DataFrame, k: int) -> list[int]:
    """The summed distances of each cluster."""
    rows = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()  # at most k
    total = {r.cluster: int(r.s) for r in rows}
    return [total.get(j, 0) for j in range(k)]


def query(spark, sf_dir: str) -> DataFrame:
    found, centres = clustered(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    sums = inertia(found, len(centres))
    fits = lambda x: F.lit(x if x < 1 << 63 else None).cast("long")
    digests = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centres]
    of = lambda values, kind: F.get(F.array(*values).cast(f"array<{kind}>"), F.col("cluster"))
    return found.select("vec_id", "cluster", "distance", of(map(fits, sums), "long").alias("cluster_inertia"), fits(sum(sums)).alias("inertia"), of(map(F.lit, digests), "string").alias("centroid_sha256"))


def _sql() -> str:
    """Every round spelt out: the centroids of each are a list in number order."""
    nearest = "(SELECT vec_id, x, arg_min(j, {{'d': d, 'j': j}}) AS j, min(d) AS d FROM (SELECT v.vec_id, v.n, v.x, c.j, list_sum(list_transform(range(1, 65), lambda i: (v.x[i] - c.c[i]) * (v.x[i] - c.c[i])))::BIGINT AS d FROM v, c{r} c) GROUP BY vec_id, n, x)"
    parts = [
        "WITH v AS MATERIALIZED (SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS x FROM embeddings WHERE len(embedding) = 64 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))))",
        "c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id), x) - 1 AS j, x AS c FROM v WHERE vec_id IS NOT NULL ORDER BY sha256('3:' || vec_id), x LIMIT 8)",
    ]
    for r in range(ROUNDS):
        parts.append(f"a{r} AS MATERIALIZED {nearest.format(r=r)}")
        parts.append(f"s{r} AS (SELECT j, i, sum(y) AS s, count(*) AS n FROM (SELECT j, unnest(range(1, 65)) AS i, unnest(x) AS y FROM a{r}) GROUP BY j, i)")
        parts.append(f"m{r} AS (SELECT j, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS c FROM s{r} GROUP BY j)")
        parts.append(f"c{r + 1} AS MATERIALIZED (SELECT c.j, coalesce(m.c, c.c) AS c FROM c{r} c LEFT JOIN m{r} m ON m.j = c.j)")
    parts.append(f"z AS MATERIALIZED {nearest.format(r=ROUNDS)}")
    return ", ".join(parts) + f" SELECT z.vec_id, z.j::INTEGER AS cluster, z.d AS distance, (sum(z.d) OVER (PARTITION BY z.j))::BIGINT AS cluster_inertia, (sum(z.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.c, ',')) AS centroid_sha256 FROM z JOIN c{ROUNDS} c ON c.j = z.j"


SQL = _sql()
