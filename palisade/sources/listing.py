"""Evidence folders listed by executors, as a Python data source.

    spark.dataSource.register(ListingSource)
    spark.read.format("evidence_listing").option("months", "May 2026").load("/evidence")

The driver looks at the folders of the first LEVELS levels only; each of them is a partition that
lists its own files, and each on the last of these levels one that walks all that is below it. Names
that begin with _ and files without bytes are listed like all others, and only the
months asked for are visited. Stores are opened by pyarrow (local and mounted folders, hdfs, s3, gs).
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from palisade.schemas import EVIDENCE

LEVELS = 2


def opened(root: str) -> tuple[fs.FileSystem, str]:
    """The store of a root and the root's path in it."""
    store, path = fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), root)
    return store, path.rstrip("/")


class Folder(InputPartition):
    def __init__(self, path: str, whole: bool):
        super().__init__(path)
        self.path, self.whole = path, whole


class ListingReader(DataSourceReader):
    def __init__(self, root: str, months: list[str] | None, levels: int = LEVELS):
        self.root, self.months, self.levels = root, months, levels

    def partitions(self) -> list[Folder]:
        store, top = opened(self.root)
        level, out = [top], []
        for depth in range(self.levels):
            out += [Folder(p, False) for p in level]
            below = [i for p in level for i in store.get_file_info(fs.FileSelector(p, allow_not_found=True)) if i.type == fs.FileType.Directory]
            level = sorted(i.path for i in below if depth or self.months is None or i.base_name in self.months)
        return out + [Folder(p, True) for p in level]

    def read(self, partition: Folder) -> Iterator[tuple]:
        store, top = opened(self.root)
        for i in store.get_file_info(fs.FileSelector(partition.path, allow_not_found=True, recursive=partition.whole)):
            if i.type == fs.FileType.File:
                yield i.path[len(top) + 1 :], i.mtime_ns // 1000 if i.mtime_ns else 0, i.size


class ListingSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "evidence_listing"

    def schema(self) -> str:
        return "path string, micros long, length long"

    def reader(self, schema) -> ListingReader:
        months = self.options.get("months")
        return ListingReader(self.options["path"], json.loads(months) if months else None, int(self.options.get("levels", LEVELS)))


def _read_batches(root: str, most_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = opened(root)
        for batch in batches:
            for row in batch.to_pylist():  # a file at a time: contents may be large
                if row["length"] > most_bytes:
                    continue
                try:
                    with store.open_input_stream(f"{top}/{row['path']}") as stream:
                        content = stream.read()
                except FileNotFoundError:  # it went after it was listed
                    continue
                yield pa.RecordBatch.from_pylist([{**row, "content": content}], pa.schema([*batch.schema, pa.field("content", pa.binary())]))

    return run


def listed(spark: SparkSession, root: str, months: list[str] | None = None) -> DataFrame:
    """path below root, modificationTime, length of every file, of some months (first folders) or all."""
    spark.dataSource.register(ListingSource)
    reader = spark.read.format("evidence_listing")
    if months is not None:
        reader = reader.option("months", json.dumps(months))
    return reader.load(root).select("path", F.timestamp_micros("micros").alias("modificationTime"), "length")


def contents(files: DataFrame, root: str, most_bytes: int) -> DataFrame:
    """EVIDENCE rows of listed files of at most this many bytes; reading is dealt out by path, however the folders are cut."""
    names = [c.split(" ")[0] for c in EVIDENCE.split(", ")]
    dealt = files.repartition("path").select("path", "modificationTime", "length")
    return dealt.mapInArrow(_read_batches(root, most_bytes), "path string, modificationTime timestamp, length long, content binary").select(*names)
