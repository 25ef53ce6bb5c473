"""Mixing sources to target weights by systematic sampling.

Built-in functions only. Every document expects target / source_size copies;
the copies are summed along the documents of a source, one random offset is
added, and a document is emitted once for each integer its stretch crosses.
Documents go by size, so the sampled words differ from the target by at most
the size of the source's longest document.

The running sum never sorts a source in one task: documents are counted by
(source, size, bucket of the id's hash), the counts are summed, and only the
rank inside such a cell needs a window. A source with a third of all rows, or
one size that all its copies share, is so spread over BUCKETS cells.

Defined cases: null text has size 0; null sources form one source, last in
order; sources of size 0 have target 0 and are taken never; rows that repeat a
doc_id count each; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palisade.llm.store import written

WEIGHTS, SHARE, MOST, SEED = (5, 2, 1), 1.5, 2, 20240607
#: Cells of each (source, size): three hexadecimal digits of the id's hash.
BUCKETS = 16**3


def digits(value: Column, seed: int, n: int) -> Column:
    """The first n hexadecimal digits of a hash of value and seed, as a number."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(value, F.lit("")))), 1, n), 16, 10).cast("long")


def words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """skey, source_size, target of each source; one row a source, so one task holds them.

    target = min(most * size, level * weight), with the level at which all
    targets make up share of all sizes: sources are full in order of
    size / weight, so the level follows from running sums.
    """
    everyone, upto = Window.partitionBy(), Window.orderBy("ratio", "skey").rowsBetween(Window.unboundedPreceding, -1)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(Window.orderBy("skey")) - 1) % len(weights) + 1).cast("int"))
    s = sizes.withColumn("w", weight).withColumn("ratio", most * F.col("source_size") / F.col("w"))
    s = s.withColumn("full", F.coalesce(F.sum(most * F.col("source_size")).over(upto), F.lit(0))).withColumn("w_full", F.coalesce(F.sum("w").over(upto), F.lit(0)))
    s = s.withColumn("left", share * F.sum("source_size").over(everyone) - F.col("full")).withColumn("w_left", F.sum("w").over(everyone) - F.col("w_full"))
    s = s.withColumn("is_open", F.col("left") * F.col("w") <= most * F.col("source_size") * F.col("w_left"))
    first = F.first(F.when(F.col("is_open"), F.struct("left", "w_left")), ignorenulls=True).over(Window.orderBy("ratio", "skey").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    s = s.withColumn("level", first)
    target = F.least(F.col("level.left") * F.col("w") / F.col("level.w_left"), (most * F.col("source_size")).cast("double"))
    return s.select("skey", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED, weights=WEIGHTS, share: float = SHARE) -> DataFrame:
    """One row a document: doc_id, size, source_size, target, copies, taken (copies * size)."""
    source = F.col(source_col).cast("string")
    sized = written(
        docs.select(F.col(id_col).alias("doc_id"), F.when(source.isNull(), "z").otherwise(F.concat(F.lit("a"), source)).alias("skey"), words(F.col(text_col)).alias("size"), digits(F.col(id_col).cast("string"), seed, 3).cast("int").alias("cell")),
        "sized",
    )
    cells = written(sized.groupBy("skey", "size", "cell").agg(F.count("*").alias("n")), "cells")
    steps = written(cells.groupBy("skey", "size").agg(F.sum("n").alias("n_size")), "steps")
    sources = targets(steps.groupBy("skey").agg(F.sum(F.col("size") * F.col("n_size")).alias("source_size")), weights, share)
    before = lambda what, *by: F.coalesce(F.sum(what).over(by[0].rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    steps = steps.withColumn("start", before("n_size", Window.partitionBy("skey").orderBy("size"))).drop("n_size").join(sources, "skey")
    cells = cells.withColumn("inner", before("n", Window.partitionBy("skey", "size").orderBy("cell"))).drop("n").join(steps, ["skey", "size"])
    cells = written(cells.select("skey", "size", "cell", (F.col("start") + F.col("inner")).alias("at"), "source_size", "target"), "starts")
    ranked = sized.withColumn("rank", F.row_number().over(Window.partitionBy("skey", "size", "cell").orderBy("doc_id")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    offset = digits(F.col("skey"), seed, 7) / float(1 << 28)
    upto = lambda k: F.floor((F.col("at") + F.col("rank") - k) * rate + offset)
    rows = ranked.join(cells, ["skey", "size", "cell"])
    return rows.select("doc_id", "size", "source_size", "target", F.least(upto(0) - upto(1), F.lit(MOST).cast("long")).alias("copies")).withColumn("taken", F.col("copies") * F.col("size"))


def query(spark, sf_dir: str) -> DataFrame:
    return mixed(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN 'z' ELSE 'a' || source END AS skey,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
src AS (SELECT skey, CAST(sum(size) AS BIGINT) AS source_size, [5, 2, 1][(row_number() OVER (ORDER BY skey) - 1) % 3 + 1] AS w FROM d GROUP BY skey),
fill AS (
  SELECT 0 AS round, []::VARCHAR[] AS full_keys, 0::DOUBLE AS level
  UNION ALL
  SELECT round + 1, (SELECT list(skey) FROM src WHERE list_contains(full_keys, skey) OR 2 * source_size < w * x.lv), x.lv
  FROM (SELECT round, full_keys, (SELECT (1.5 * sum(source_size) - coalesce(sum(2 * source_size) FILTER (list_contains(full_keys, skey)), 0)) / sum(w) FILTER (NOT list_contains(full_keys, skey)) FROM src) AS lv FROM fill WHERE round < 200) x
  WHERE round = 0 OR EXISTS (SELECT 1 FROM src WHERE NOT list_contains(full_keys, skey) AND 2 * source_size < w * x.lv)),
lv AS (SELECT max_by(full_keys, round) AS fk FROM fill),
t AS (SELECT skey, source_size, CASE WHEN list_contains(fk, skey) THEN 2.0 * source_size
    ELSE (SELECT 1.5 * sum(source_size) - coalesce(sum(2 * source_size) FILTER (list_contains(fk, skey)), 0) FROM src) * w
       / (SELECT sum(w) FILTER (NOT list_contains(fk, skey)) FROM src) END AS target FROM src, lv),
r AS (SELECT d.*, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
    row_number() OVER (PARTITION BY skey ORDER BY size, substr(md5('20240607:' || doc_id), 1, 3), doc_id) AS i,
    CAST('0x' || substr(md5('20240607:' || skey), 1, 7) AS BIGINT) / 268435456.0::DOUBLE AS u FROM d JOIN t USING (skey))
SELECT doc_id, size, source_size, CAST(target AS DOUBLE) AS target,
  CAST(least(floor(i * rate + u) - floor((i - 1) * rate + u), 2) AS BIGINT) * size AS taken FROM r
"""
