"""Connected components by alternating large and small stars, in tables alone.

Each round is two grouped minima and two joins over the edges; the edges are
written to the shared folder, so lineage stays short. Minima are combined before
the shuffle, so a node with many edges costs one row a task; the joins are between
plain tables, which adaptive execution can split where a key is hot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.store import written


def _unfinished(edges: DataFrame) -> bool:
    """Whether some node has two roots, or is a root and has one: else the edges are stars, one a component."""
    ends = edges.select(F.col("u").alias("id"), F.lit(1).alias("low"), F.lit(0).alias("root")).unionAll(edges.select("v", F.lit(0), F.lit(1)))
    seen = ends.groupBy("id").agg(F.sum("low").alias("low"), F.max("root").alias("root"))
    return seen.agg(F.max((F.col("low") + F.col("root") > 1).cast("int"))).first()[0] == 1


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """id, component (its smallest id) of every node that an edge between two nodes names."""
    edges = written(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    while _unfinished(edges):
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large, "large")
        least = written(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
        edges = written(small.where("u <> v").distinct(), "edges")
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionAll(edges.select(F.col("v").alias("id"), F.col("v").alias("component"))).distinct()
