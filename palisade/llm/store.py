"""Tables in the shared folder, and joins whose broadcast side is measured first.

A table written here cuts the lineage of what reads it: lost executors cost at
most the tasks they ran, never a whole iterative history.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A side is broadcast only while its measured rows take at most this many bytes.
BROADCAST_BYTES = 8 << 20

_written: list[tuple[SparkSession, str]] = []
_tables: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, or for local runs without one a folder of this process."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = f"file://{tempfile.mkdtemp(prefix='palisade-')}"
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def stored(df: DataFrame, name: str) -> str:
    """The path of df as a Parquet table in the shared folder."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "snappy").parquet(path)  # its codec needs little memory outside the heap
    _written.append((spark, path))
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read again."""
    return df.sparkSession.read.schema(df.schema).parquet(stored(df, name))


def discard(spark: SparkSession, path: str) -> None:
    """Delete one table of the shared folder that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    _written.remove((spark, path))


def bucketed(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """df as a table in the shared folder whose files are bucketed by key: rows of a key are read together without a shuffle."""
    spark = df.sparkSession
    table = f"palisade_{name}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/tables/{table}"
    df.write.bucketBy(buckets, key).format("parquet").option("compression", "gzip").option("path", path).saveAsTable(table)  # codes by frequency, in little memory
    _written.append((spark, path))
    _tables.append((spark, table))
    return spark.table(table)


def release(spark: SparkSession) -> None:
    """Delete the tables this session has written; results that still read them become unreadable."""
    for entry in [e for e in _tables if e[0] is spark]:
        spark.sql(f"DROP TABLE IF EXISTS {entry[1]}")
        _tables.remove(entry)
    for _, path in [e for e in _written if e[0] is spark]:
        discard(spark, path)


@atexit.register
def _at_exit() -> None:
    for spark in {id(s): s for s, _ in _written}.values():
        try:
            release(spark)
        except Exception:  # the JVM may have gone first
            return


#: Bytes of rows that go to a Python worker at once, where the session has Spark's own bound of 64 MB.
BATCH_BYTES = "4m"


def small_batches(df: DataFrame) -> DataFrame:
    """df, after bounding what its Python workers hold at once; long texts make row counts a poor bound."""
    conf = df.sparkSession.conf
    if conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b") in ("67108864", "64m"):
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return df


def trim_memory() -> None:
    """Give what a Python worker has freed back to the machine: workers live on between tasks."""
    import ctypes
    import gc

    import pyarrow

    gc.collect()
    pyarrow.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


#: What a row of a broadcast table takes besides its values.
ROW_BYTES = 48


def measured(df: DataFrame) -> int:
    """Bytes that the rows of df take in a broadcast, from the lengths of their values."""

    def width(f):
        kind = f.dataType
        value = F.col(f"`{f.name}`")
        if isinstance(kind, (T.StringType, T.BinaryType)):
            return F.octet_length(value)
        return F.octet_length(F.to_json(F.struct(value))) if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)) else F.lit(8)

    row = sum((F.coalesce(width(f), F.lit(0)) for f in df.schema.fields), F.lit(ROW_BYTES).cast("long"))
    return df.agg(F.coalesce(F.sum(row), F.lit(0))).first()[0]


def small_enough(df: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """Whether the rows of df, measured, fit in limit."""
    return measured(df) <= limit


def semi(df: DataFrame, keys: DataFrame, on: list[str], how: str = "left_semi") -> DataFrame:
    """Semi or anti join; keys (a written table) is broadcast when its measured size allows, else both sides shuffle."""
    return df.join(F.broadcast(keys) if small_enough(keys) else keys, on, how)


#: Bytes of the bitmap that Spark makes of each 32,768 neighbouring numbers.
BITMAP_BYTES = 4096


def bitmaps(ids: DataFrame, key: str) -> DataFrame | None:
    """bucket, bits of the ids in column key, a row for each 32,768 neighbours and each value of the other columns; None if they are not whole numbers or lie too far apart to be broadcast so."""
    if not isinstance(ids.schema[key].dataType, T.IntegralType):
        return None
    others = [c for c in ids.columns if c != key]
    rows = ids.where(F.col(key).isNotNull()).select(F.bitmap_bucket_number(key).alias("bucket"), F.bitmap_bit_position(key).alias("bit"), *others)
    if rows.select("bucket", *others).distinct().count() * (BITMAP_BYTES + ROW_BYTES + 8 * len(ids.columns)) > BROADCAST_BYTES:
        return None
    # ids travel, not the mostly empty bitmaps of single tasks
    return written(rows.repartition("bucket").groupBy("bucket", *others).agg(F.bitmap_construct_agg("bit").alias("bits")), "bitmaps")


def has_bit(value: Column, bits: Column) -> Column:
    """Whether the bitmap of value's bucket holds value."""
    at = F.bitmap_bit_position(value)
    byte = F.conv(F.hex(F.substring(bits, F.shiftright(at, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, at.bitwiseAND(7).cast("int")) == 1


def join_ids(df: DataFrame, ids: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """df joined with ids (a written table: distinct ids in column key, in other columns few different numbers) on key.

    ids is broadcast when its measured size allows, or else as bitmaps, about a bit an id where ids are dense; else both sides shuffle.
    """
    side, on = ids, df[key] == ids[key]
    few = small_enough(ids)
    if not few and (packed := bitmaps(ids, key)) is not None:
        few, side, on = True, packed, (F.bitmap_bucket_number(df[key]) == packed["bucket"]) & has_bit(df[key], packed["bits"])
    others = [side[c] for c in ids.columns if c != key and how == "inner"]
    return df.join(F.broadcast(side) if few else side, on, how).select(*[df[c] for c in df.columns], *others)
