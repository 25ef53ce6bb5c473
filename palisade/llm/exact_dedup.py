"""Exact dedup: 128-bit content hash groups, smallest id, byte comparison inside groups.

Built-in functions only. The texts of single documents are never shuffled:
first (hash, id) pairs find the groups of two or more, then only the members
of those groups bring their texts, already combined before the shuffle, so a
group that holds a third of all rows costs one row a map task.

Defined cases: a null text counts as empty; all empty texts are one group;
rows that repeat a doc_id carry the same decision; a row without doc_id is kept
only where no row of its group has one; an empty table gives no rows; columns
other than id and text are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.llm.store import written

BLANKS = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), BLANKS, " ")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = docs.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("norm"))
    digests = written(rows.select("doc_id", F.unhex(F.md5("norm")).alias("h"), F.unhex(F.sha2("norm", 256)).alias("sha")), "digests")
    several = written(digests.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "several")
    members = rows.withColumn("h", F.unhex(F.md5("norm"))).join(several, "h", "left_semi")
    # the grouping compares the bytes of the texts; sha is only the name a class goes by from here on
    classes = written(
        members.groupBy("h", "norm").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size")).select("h", F.unhex(F.sha2("norm", 256)).alias("sha"), "keep_id", "group_size"),
        "classes",
    )
    return digests.join(classes, ["h", "sha"], "left").select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.when(F.col("group_size").isNull(), True).otherwise(F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM d WINDOW w AS (PARTITION BY norm)
"""
