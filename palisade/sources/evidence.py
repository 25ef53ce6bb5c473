"""Evidence folders as tables: bytes, decoded text, CSV rows, PDF pages."""

from __future__ import annotations

import codecs
import csv
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.functions.text import extension
from palisade.schemas import EVIDENCE
from palisade.sources import listing

HEAD = 8192
DELIMITERS = ",;\t|"
MOST_PAGES, LEAST_PAGE_CHARS = 500, 24


def evidence_files(spark: SparkSession, root: str, most_bytes: int = 100 << 20, include_empty: bool = True, months: list[str] | None = None) -> DataFrame:
    """EVIDENCE rows with paths below root, of some months (first folders) or all.

    Executors list the folders and read the files (sources.listing), so names that begin with _ and
    files without bytes, which are evidence that fails to parse, are there. A store
    that only Spark can open is read by Spark's own reader, which hides these names.
    """
    try:
        listing.opened(root)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return spark_files(spark, root, most_bytes, include_empty)
    files = listing.listed(spark, root, months)
    return listing.contents(files if include_empty else files.where("length > 0"), root, most_bytes)


def spark_files(spark: SparkSession, root: str, most_bytes: int, include_empty: bool) -> DataFrame:
    """The same by Spark's reader, which leaves out files without bytes; the driver's listing adds them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").schema(EVIDENCE).load(root)
    base = F.regexp_replace(F.lit(root.rstrip("/")), "^[a-z]+:(//)?", "")
    below = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:(//[^/]*)?/*", "/"), F.concat(F.lit(r"^\Q"), base, F.lit(r"\E/?")), "")
    found = files.where(F.col("length") <= most_bytes).withColumn("path", F.url_decode(F.replace(below, F.lit("+"), F.lit("%2B"))))
    return found.unionByName(empty_files(spark, root)) if include_empty else found


def empty_files(spark: SparkSession, root: str) -> DataFrame:
    """EVIDENCE rows of the files of length 0 below root."""
    top = spark._jvm.org.apache.hadoop.fs.Path(root)
    system = top.getFileSystem(spark._jsc.hadoopConfiguration())
    start = len(system.makeQualified(top).toUri().getPath()) + 1
    listed, rows = system.listFiles(top, True), []
    while listed.hasNext():
        status = listed.next()
        path = status.getPath().toUri().getPath()[start:]
        if status.getLen() == 0 and not any(p.startswith((".", "_")) for p in path.split("/")):
            rows.append((path, status.getModificationTime()))
    df = spark.createDataFrame(rows, "path string, ms long")
    return df.select("path", F.timestamp_millis("ms").alias("modificationTime"), F.lit(0).cast("long").alias("length"), F.lit(b"").alias("content"))


def decode(data: bytes) -> tuple[str, str, list[str]]:
    """Text, encoding and warnings: UTF-8, UTF-16 where a mark or its zero bytes show it, Windows-1252, or replacement."""
    try:
        return data.decode("utf-8-sig"), "utf-8-sig", []
    except UnicodeDecodeError:
        pass
    marked = data.startswith((codecs.BOM_UTF16_LE, codecs.BOM_UTF16_BE))
    for encoding in ["utf-16"] * (marked or b"\0" in data) + ["cp1252"]:
        try:
            return data.decode(encoding), encoding, [f"Decoded using {encoding} fallback."]
        except UnicodeDecodeError:
            continue
    return data.decode("utf-8", errors="replace"), "utf-8-replace", ["Undecodable bytes were replaced."]


def _decode_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [decode(x.as_py() or b"") for x in batch.column(1)]
        columns = [pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.string()), pa.array([o[2] for o in out], pa.list_(pa.string()))]
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["source_id", "text", "encoding", "decode_warnings"])


def decoded_text(files: DataFrame) -> DataFrame:
    """source_id, text, encoding, decode_warnings of files (source_id, content). Valid UTF-8 never leaves the JVM."""
    plain = F.is_valid_utf8(F.col("content").cast("string"))
    easy = files.where(plain).select("source_id", F.regexp_replace(F.col("content").cast("string"), "^﻿", "").alias("text"), F.lit("utf-8-sig").alias("encoding"), F.array().cast("array<string>").alias("decode_warnings"))
    rest = files.where(~plain).select("source_id", "content").mapInArrow(_decode_batches, "source_id string, text string, encoding string, decode_warnings array<string>")
    return easy.unionByName(rest)


def content_error(path: Column, content: Column) -> Column:
    """Why a file's first bytes don't fit its name; NULL if they do. An error is a value, so one file never fails a job."""
    ext, head = extension(path), F.substring(content, 1, HEAD)
    starts = lambda hexes: F.startswith(F.hex(F.substring(content, 1, len(hexes) // 2)), F.lit(hexes))
    text = ext.isin(".txt", ".log", ".csv")
    zero = F.contains(F.hex(F.regexp_replace(F.hex(head), "(..)", "$1 ").cast("binary")), F.lit("3030" + "20"))  # a byte 00 between the spaced pairs
    utf16 = starts("FFFE") | starts("FEFF")
    blank = F.trim(F.regexp_replace(F.hex(head), "(09|0A|0B|0C|0D|20|EFBBBF)", "")) == ""
    return (
        F.when(F.octet_length(content) == 0, "The uploaded file is empty.")
        .when((ext == ".pdf") & ~starts("255044462D"), "The file extension is PDF but the content is not a PDF.")
        .when((ext == ".png") & ~starts("89504E470D0A1A0A"), "The file extension is PNG but the content is not a PNG image.")
        .when(ext.isin(".jpg", ".jpeg") & ~starts("FFD8FF"), "The file extension is JPEG but the content is not a JPEG image.")
        .when(text & zero & ~utf16, "The text log contains unexpected binary data.")
        .when(text & blank, "The text log is empty.")
        .when(~(text | ext.isin(".pdf", ".png", ".jpg", ".jpeg")), "Unsupported structured log type.")
    )


def read_csv(text: str) -> tuple[list[str], str, list[dict[str, str]]]:
    """Headers, delimiter and rows; missing cells are '', surplus cells stand under ''."""
    try:
        dialect = csv.Sniffer().sniff(text[:HEAD], delimiters=DELIMITERS)
    except csv.Error:
        dialect = csv.excel
    trim = lambda v: str(v or "").strip()
    reader = csv.DictReader(io.StringIO(text), dialect=dialect)
    headers = [trim(h) for h in reader.fieldnames or []]
    return headers, dialect.delimiter, [{trim(k): trim(v) for k, v in row.items()} for row in reader]


def _csv_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    fields = pa.map_(pa.string(), pa.string())
    for batch in batches:
        for source, text in zip(batch.column(0), batch.column(1), strict=True):
            try:
                headers, delimiter, rows = read_csv(text.as_py() or "")
            except csv.Error:
                continue
            n = len(rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array([source.as_py()] * n, pa.string()), pa.array(range(n), pa.int32()), pa.array([list(r.items()) for r in rows], fields), pa.array([headers] * n, pa.list_(pa.string())), pa.array([delimiter] * n, pa.string())],
                names=["source_id", "row_no", "fields", "headers", "delimiter"],
            )


def csv_rows(files: DataFrame) -> DataFrame:
    """source_id, row_no, fields map, headers, delimiter of files (source_id, text); quoted line ends stay in their cell."""
    return files.select("source_id", "text").mapInArrow(_csv_batches, "source_id string, row_no int, fields map<string,string>, headers array<string>, delimiter string")


def with_page_images(pages: DataFrame, images: DataFrame) -> DataFrame:
    """pages (source_id, page_no, native_text) with image_tokens: the recognised texts, in their order, of each page's largest image.

    images: source_id, page_no, image_no, width, height, tokens (array of text by order); of equal sizes the first image counts.
    """
    largest = F.max_by("tokens", F.struct((F.col("width").cast("long") * F.col("height")).alias("size"), (-F.col("image_no")).alias("first")))
    chosen = images.groupBy("source_id", "page_no").agg(largest.alias("image_tokens"))
    return pages.join(chosen, ["source_id", "page_no"], "left").withColumn("image_tokens", F.coalesce("image_tokens", F.array().cast("array<string>")))


def pdf_text(pages: DataFrame) -> DataFrame:
    """source_id, text, used_ocr, warnings, too_long from pages (source_id, page_no, native_text, image_tokens array<string>).

    Pages come from an extractor outside: a page's own text counts with 24
    characters or more, else the recognised text of its largest image.
    """
    native = F.length(F.trim("native_text")) >= LEAST_PAGE_CHARS
    seen = F.size("image_tokens") > 0
    text = F.when(native, F.col("native_text")).when(seen, F.array_join("image_tokens", "\n"))
    lacks = F.when(F.coalesce(native, F.lit(False)) | seen, F.lit(None)).otherwise(F.concat(F.lit("PDF page "), F.col("page_no").cast("string"), F.lit(" has insufficient native text and was not OCR-scanned.")))
    page = F.struct("page_no", text.alias("text"), lacks.alias("warning"), (~F.coalesce(native, F.lit(False)) & seen).alias("ocr"))
    df = pages.groupBy("source_id").agg(F.array_sort(F.collect_list(page)).alias("p"), F.count("*").alias("n"))
    keep = lambda name: F.filter(F.transform("p", lambda x: x[name]), lambda x: x.isNotNull())
    return df.select("source_id", F.array_join(keep("text"), "\n").alias("text"), F.exists("p", lambda x: x["ocr"]).alias("used_ocr"), keep("warning").alias("warnings"), (F.col("n") > MOST_PAGES).alias("too_long"))
