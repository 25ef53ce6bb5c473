"""State that people and earlier runs leave: settings, verdicts, caches, audit."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palisade.schemas import AUDIT

#: Thresholds by engine.
DEFAULT_THRESHOLDS = {"clamwin": 0.0, "mcafee": 0.0, "trellix": 0.0, "symantec": 0.0, "zero_threat_confidence": 0.9}
STRICTNESS = ("high", "medium", "low")
MOST_THRESHOLD = 1_000_000
AUDIT_CHARS = 128
CACHE_ROWS = 2000


def state(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON-lines state file; unknown keys are dropped, malformed rows become NULL rows and go."""
    df = spark.read.schema(f"{schema}, _bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    return df.where("_bad is null").drop("_bad")


def latest(log: DataFrame, key: str, order: str, tombstone: Column | None = None) -> DataFrame:
    """The last row of each key of an append-only log; keys whose last row is a tombstone are gone."""
    names = [c for c in log.columns if c != key]
    df = log.groupBy(key).agg(F.max_by(F.struct(*names), F.struct(order, F.xxhash64(*names))).alias("_last")).select(key, "_last.*")
    return df if tombstone is None else df.where(~tombstone)


def valid_threshold(engine: Column, value: Column) -> Column:
    """Whether a setting may be stored: finite and in its range, or one of the strictness names."""
    number = value.try_cast("double")
    finite = number.isNotNull() & ~F.isnan(number) & (F.abs(number) != math.inf)
    top = F.when(engine == "zero_threat_confidence", 0.99).otherwise(float(MOST_THRESHOLD))
    return F.when(engine == "ocr_strictness", value.isin(*STRICTNESS)).otherwise(F.coalesce(finite & number.between(0, top), F.lit(False)))


def clamped(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def evicted(cache: DataFrame, order: str, keep: int = CACHE_ROWS) -> DataFrame:
    """The newest rows of a cache; the bound is the feature."""
    return cache.orderBy(F.desc(order)).limit(keep)


def append_audit(rows: DataFrame, path: str) -> None:
    """Append audit rows (AUDIT) as JSON lines; names are cut to their bound."""
    cut = [F.left(F.col(c), F.lit(AUDIT_CHARS)).alias(c) if c in ("event", "actor") else F.col(c) for c in ("ts", "event", "actor", "details")]
    rows.select(*cut).write.mode("append").json(path)


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(AUDIT).json(path)


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, put in the place of an older one in one step."""
    import uuid

    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    fs = jvm.org.apache.hadoop.fs
    target, draft = fs.Path(path), fs.Path(f"{path}.{uuid.uuid4().hex}")
    out = target.getFileSystem(conf).create(draft, True)
    out.write(bytearray(text.encode()))
    out.close()
    over = spark.sparkContext._gateway.new_array(fs.Options.Rename, 1)
    over[0] = fs.Options.Rename.OVERWRITE
    fs.FileContext.getFileContext(target.toUri(), conf).rename(draft, target, over)


def replaced(df: DataFrame, folder: str, name: str = "CURRENT", before_swap: Callable[[], None] | None = None) -> str:
    """Write df as a new version below folder and only then move the pointer, so readers see old or new state, never part of one.

    before_swap may still refuse the version by raising.
    """
    import uuid

    version = f"{folder.rstrip('/')}/v-{uuid.uuid4().hex}"
    df.write.parquet(version)
    if before_swap:
        before_swap()
    put_text(df.sparkSession, f"{folder.rstrip('/')}/{name}", version)
    return version


def current(spark: SparkSession, folder: str, name: str = "CURRENT") -> str | None:
    """The version that the pointer of a folder names; None before the first."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{name}")
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(path):
        return None
    stream = store.open(path)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def audit_tail(audit: DataFrame, newest: int = 20) -> DataFrame:
    """The newest rows of each actor, numbered from the newest; each task keeps no more of an actor before the shuffle."""
    order = Window.partitionBy("actor").orderBy(F.desc("ts"), "event", F.to_json("details"))
    return audit.withColumn("k", F.row_number().over(order)).where(F.col("k") <= newest)


def inventory_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """path, change (added, removed, changed) between two inventories (path, content_sha256)."""
    both = old.select("path", F.col("content_sha256").alias("a")).join(new.select("path", F.col("content_sha256").alias("b")), "path", "full")
    return both.select("path", F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "changed").alias("change")).where("change is not null")


def cached_results(pointers: DataFrame, contents: DataFrame) -> DataFrame:
    """path and cached columns: pointers (path, content_sha256) to contents (content_sha256, ...); a path without an entry is not there."""
    return pointers.join(contents, "content_sha256")


def cleared(table: DataFrame) -> DataFrame:
    """The table without its rows, to overwrite it with."""
    return table.limit(0)


def portable_path(path: Column, root: str) -> Column:
    """path relative to root with / between parts; the bare name where it lies elsewhere. Also brings old absolute keys up to date."""
    tidy = F.replace(path, F.lit("\\"), F.lit("/"))
    top = root.replace("\\", "/").rstrip("/") + "/"
    relative = F.when(F.startswith(tidy, F.lit(top)), F.substring(tidy, len(top) + 1, 1 << 20))
    return F.coalesce(relative, F.when(F.startswith(tidy, F.lit("/")) | F.rlike(tidy, F.lit("^[A-Za-z]:")), F.element_at(F.split(tidy, "/"), -1)), tidy)
