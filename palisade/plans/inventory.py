"""The monthly inventory as one plan: evidence files to verdicts, matches, coverage and a summary.

Each step is a DataFrame. Files are parsed in the partition they were read in. The
classified texts, the runs, the entries and the edges are each read by several
later steps; they are cut there, so that no plan holds another and no file is
parsed twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.functions.text import evidence_month, file_name
from palisade.lineage import cut
from palisade.operators import checklist, classify, coverage, matching, ocr, parsers, paths, reconcile, scan_text, verdicts
from palisade.sources.evidence import content_error, csv_rows, decoded_text, pdf_text

NO_RUN = "No supported completed scan run could be parsed from this file."


def structured_runs(files: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """SCAN_RUN rows with document_role and path, of files (path, content, length, modificationTime) after paths.inventory()."""
    sound = files.where(F.col("kind").isin("text", "pdf") & ~F.col("too_large")).withColumn("error", content_error(F.col("path"), F.col("content"))).where("error is null")
    base = sound.select(F.sha2("content", 256).alias("source_id"), "path", "month", F.col("modificationTime").cast("timestamp_ntz").alias("mtime"), "content", paths.kind(F.col("path")).alias("kind"))
    texts = decoded_text(base.where("kind = 'text'").select("source_id", "content").dropDuplicates(["source_id"])).select("source_id", "text")
    if pages is not None:
        texts = texts.unionByName(pdf_text(pages).where("not too_long").select("source_id", "text"))
    docs = base.drop("content").join(texts, "source_id")
    is_csv = F.lower(file_name(F.col("path"))).endswith(".csv")
    rows = cut(csv_rows(docs.where(is_csv).select("source_id", "text").dropDuplicates(["source_id"])))
    headers = rows.groupBy("source_id").agg(F.first("headers").alias("headers"))
    docs = cut(classify.classified(docs.join(headers, "source_id", "left"), "text", "headers").select("source_id", "path", "month", "mtime", "kind", "text", F.col("classification.vendor").alias("vendor")))
    once = docs.dropDuplicates(["source_id"])
    of = lambda vendor: once.where(F.col("vendor") == vendor)
    pdf = F.col("kind") == "pdf"
    mcafee = of("trellix_mcafee")
    epo = parsers.epo_rows(mcafee).withColumn("document_role", F.lit("epo_dat_report"))
    rest = mcafee.join(epo.select(F.col("source_file_id").alias("source_id")).distinct(), "source_id", "left_anti")
    total = parsers.epo_threat_total(rest.where(pdf)).withColumn("document_role", F.lit("epo_threat_report"))
    rest = rest.join(total.select(F.col("source_file_id").alias("source_id")).distinct(), "source_id", "left_anti")
    csv_of = lambda vendor: rows.join(of(vendor).select("source_id"), "source_id", "left_semi")
    runs = [
        epo,
        total,
        parsers.activity_runs(rest).withColumn("document_role", F.lit("mcafee_scan_log")),
        parsers.block_runs(of("clamwin")).withColumn("document_role", F.lit("clamwin_scan_log")),
        parsers.symantec_runs(of("symantec")).withColumn("document_role", F.lit("symantec_scan_log")),
        parsers.event_runs(csv_of("trend_micro")).withColumn("document_role", F.lit("trend_system_events")),
        parsers.generic_csv_runs(csv_of("generic_antivirus")).withColumn("document_role", F.lit("generic_scan_csv")),
    ]
    all_runs = runs[0]
    for more in runs[1:]:
        all_runs = all_runs.unionByName(more)
    named = docs.select(F.col("source_id").alias("source_file_id"), "path", "month")
    joined = all_runs.join(named, "source_file_id")
    return cut(verdicts.in_evidence_month(joined, evidence_month(F.col("month")), "path"))


def entries(files: DataFrame, thresholds: dict[str, float] | None = None, strictness: str = "high", pages: DataFrame | None = None, tokens: DataFrame | None = None) -> DataFrame:
    """One row a file: placement, verdict, version, time, reasons, parse_failed. Files without a structured run are read as plain text."""
    files = paths.inventory(files).withColumn("content_sha256", F.sha2("content", 256))
    runs = structured_runs(files, pages)
    roles = runs.groupBy("path").agg(F.first("document_role").alias("role"))
    told = verdicts.file_verdicts(runs, "path").join(roles, "path").select("path", "status", "dat_version", "last_scan", "reasons", "role", F.lit(False).alias("is_outdated"))
    sound = files.withColumn("error", F.when(F.col("too_large"), "The file exceeds the configured processing limit.").otherwise(F.when(F.col("kind") != "image", content_error(F.col("path"), F.col("content")))))
    left = sound.join(told.select("path"), "path", "left_anti")
    texts = left.where("kind = 'text' and error is null").select(F.col("path").alias("source_id"), "content", "system", "month")
    plain = decoded_text(texts.select("source_id", "content")).join(texts.select("source_id", "system", F.col("month").alias("folder")), "source_id")
    none = F.array().cast("array<string>")
    read = scan_text.text_verdicts(plain, strictness, thresholds).select(F.col("source_id").alias("path"), "status", "dat_version", "last_scan", none.alias("reasons"), F.lit("unknown").alias("role"), "is_outdated")
    seen = told.unionByName(read)
    if tokens is not None:
        named = files.select(F.col("path").alias("image"), "system", F.col("month").alias("folder"))
        shots = ocr.audits(tokens.join(named, "image"), strictness, thresholds)
        seen = seen.unionByName(shots.select(F.col("image").alias("path"), "status", "dat_version", "last_scan", "reasons", F.lit("unknown").alias("role"), F.col("outdated").alias("is_outdated")))
    df = sound.drop("content").join(seen, "path", "left")
    failed = F.col("error").isNotNull() | (F.col("status").isNull() & (F.col("kind") != "image"))
    status = F.coalesce("status", F.when(F.col("kind") == "image", verdicts.NOT_SCANNED).otherwise(verdicts.MANUAL))
    reasons = F.when(failed, F.array(F.coalesce("error", F.lit(NO_RUN)))).otherwise(F.coalesce("reasons", none))
    return df.withColumns({
        "status": status,
        "dat_version": F.coalesce("dat_version", F.lit("Unknown")),
        "last_scan": F.coalesce("last_scan", F.lit("Unknown")),
        "verification_reasons": reasons,
        "role": F.coalesce("role", F.lit("unknown")),
        "is_outdated": F.coalesce("is_outdated", F.lit(False)),
        "parse_failed": failed,
        "filename": F.col("display"),
    }).drop("error", "reasons")


def monthly(files: DataFrame, cells: DataFrame | None = None, human_verdicts: DataFrame | None = None, **options) -> dict[str, DataFrame]:
    """The whole month: entries, edges, assignments, tree, missing, reconciliation, summary."""
    found = cut(reconcile.with_companions(entries(files, **options)))
    spark = files.sparkSession
    rows = checklist.checklist_rows(cells) if cells is not None else spark.createDataFrame([], "id string, system string, location string, item string, pc_name string, tokens array<string>, av_software string, dat_version string, date_scan string, virus_found string, sheet string, row int, sheet_pos int")
    rows = cut(rows)
    scored = matching.matches(found, rows)
    best = cut(matching.best_of(scored))
    matched = matching.outcomes(found, best, matching.assigned_of(scored, best))
    found = found.join(matched.select("path", "row_id", F.col("ambiguous").alias("match_ambiguous"), F.col("reason").alias("match_reason")), "path", "left")
    wanted = rows.select(F.col("id").alias("row_id"), F.col("dat_version").alias("chk_dat"), F.col("date_scan").alias("chk_date"), "virus_found")
    found = found.join(wanted, "row_id", "left")
    told = lambda c: F.coalesce(c, F.lit(""))
    found = found.withColumn("checklist_mismatches", reconcile.mismatches(F.col("status"), F.col("system"), told("chk_dat"), F.col("dat_version"), told("chk_date"), F.col("last_scan"), told("virus_found")))
    verdict_rows = human_verdicts if human_verdicts is not None else spark.createDataFrame([], "path string, content_sha256 string, verdict string")
    found = reconcile.with_manual_verdicts(found, verdict_rows).withColumn("pdf_names", F.array().cast("array<string>"))
    placed = cut(coverage.places(found))
    tree = coverage.tree_status(checklist.expected_tree(rows).select("system", "location", "expected"), coverage.counts(placed), coverage.unknown_systems(placed))
    return {
        "entries": placed,
        "edges": matching.edges_of(scored),
        "tree": tree,
        "missing": coverage.missing_alerts(tree),
        "reconciliation": coverage.reconciliation(placed, tree),
        "summary": coverage.summary(tree, placed, cells is not None),
    }
