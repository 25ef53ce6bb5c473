"""Incremental inventory: new evidence files, each content once, with a checkpoint; an audit sink; session windows.

The batch engine has no stream of its own; these are the same operators over
readStream, so a restart goes on where the checkpoint says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.operators import paths
from palisade.schemas import EVIDENCE


def evidence_stream(spark: SparkSession, root: str, files_a_trigger: int = 1000) -> DataFrame:
    return spark.readStream.format("binaryFile").schema(EVIDENCE).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_a_trigger).load(root)


def new_contents(files: DataFrame, late: str = "1 day") -> DataFrame:
    """Files whose bytes were not seen within the watermark: one inference a content."""
    hashed = files.withColumn("content_sha256", F.sha2("content", 256))
    return hashed.withWatermark("modificationTime", late).dropDuplicatesWithinWatermark(["content_sha256"])


def start_inventory(files: DataFrame, out: str, checkpoint: str, root: str):
    """Keeps the placement of every new evidence file and tallies by batch; the query's progress is the scan's progress, stop() cancels it.

    A batch's rows and its tallies are written over what an interrupted try of the same batch has left (out/files/batch=N,
    out/tallies/batch=N), so a restart neither loses nor doubles a file. Tallies come from the batch
    alone; inventory_tallies() adds them up.
    """
    below = F.regexp_replace("path", F.lit("^.*?" + root.rstrip("/").rsplit("/", 1)[-1] + "/"), F.lit(""))
    placed = paths.inventory(files.withColumn("path", below)).drop("content")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/files/batch={number}")
        rows = batch.sparkSession.read.parquet(f"{out}/files/batch={number}")
        tallies = rows.groupBy("month", "system", "kind").agg(F.count("*").alias("n"), F.sum("length").alias("bytes"))
        tallies.write.mode("overwrite").parquet(f"{out}/tallies/batch={number}")

    return placed.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def inventory_files(spark: SparkSession, out: str) -> DataFrame:
    """Every file that start_inventory() has placed, with its batch."""
    return spark.read.parquet(f"{out}/files")


def inventory_tallies(spark: SparkSession, out: str) -> DataFrame:
    """month, system, kind, n, bytes over all batches: reads the batches' tallies, not the files' rows."""
    return spark.read.parquet(f"{out}/tallies").groupBy("month", "system", "kind").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"))


def start_audit(events: DataFrame, out: str, checkpoint: str):
    return events.writeStream.format("json").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    """user_id, start, end, n: activity windows; with late, over a stream."""
    df = events.withWatermark("ts", late) if late else events
    return df.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
