"""From raw documents to token ids: five stages, each by one operator of palisade.llm.

Every stage takes (spark, docs, sf_dir), works on all its predecessor kept and
returns the documents it keeps with their columns; the last returns token ids.
Null texts, repeated rows and empty tables go through as each operator defines.
Rows that repeat a doc_id share its decision; a row without doc_id can't be named
by a decision, so the filtering stages keep it and mixing, which must name what
it takes, leaves it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.llm import bpe, exact_dedup, minhash, mixing, toxicity
from palisade.llm.store import join_ids, written


def without(docs: DataFrame, decisions: DataFrame) -> DataFrame:
    """docs but for the ids of decisions (doc_id)."""
    return join_ids(docs, written(decisions.select("doc_id").distinct(), "dropped-ids"), "doc_id", "left_anti")


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return without(docs, toxicity.scored(docs, model).where("predicted = 1"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the smallest id stays."""
    return without(docs, exact_dedup.exact_groups(docs).where("not kept"))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five words, 0.8) the smallest id stays."""
    return without(docs, minhash.near_duplicates(docs).where("not kept"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it; rows that repeat a doc_id as often as the one taken most."""
    copies = written(mixing.mixed(docs).where("copies > 0").groupBy("doc_id").agg(F.max("copies").alias("mixed_copies")), "mix")
    taken = join_ids(docs, copies, "doc_id")
    return taken.withColumn("mixed_copy", F.explode(F.sequence(F.lit(1).cast("long"), "mixed_copies"))).select(*[docs[c] for c in docs.columns])


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, checked by decoding: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return bpe.digests(docs)


STAGES = [("toxicity", toxicity_stage), ("exact_dedup", exact_stage), ("minhash_near_dedup", near_stage), ("mixing", mixing_stage), ("byte_bpe", token_stage)]

#: Trained scores have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
