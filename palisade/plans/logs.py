"""Queries over rendered logs: text made from table columns, parsed back, compared with the columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.functions import dates
from palisade.functions.text import evidence_month
from palisade.operators import classify, parsers, verdicts
from palisade.sources.evidence import csv_rows

MTIME = "2026-05-31 12:00:00"
#: Orders, or users or customers, whose rows make one rendered file: files grow in number with a table, not in size.
ORDERS, PARTIES = 1000, 10


def table(spark, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def text_files(rows: DataFrame, file: str, order: list[str], line, head: str = "", tail: str = "") -> DataFrame:
    """source_id, text, mtime: one file for each value of file, its lines in order."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct(*order, line.alias("line")))), lambda x: x["line"])
    out = rows.groupBy(F.col(file).cast("string").alias("source_id")).agg(F.array_join(lines, "\n").alias("text"))
    return out.select("source_id", F.concat(F.lit(head), "text", F.lit(tail)).alias("text"), F.lit(MTIME).cast("timestamp_ntz").alias("mtime"))


def text(value, kind: str = "string"):
    return value.cast(kind).cast("string") if kind != "string" else value.cast("string")


def infected():
    return F.when(F.col("event_type") == "error", F.col("event_id") % 4).otherwise(0)


def block_logs(spark, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    summary = F.concat(F.lit("\n----------- SCAN SUMMARY -----------\nScanned files: "), text(F.floor(F.abs("value") * 100)), F.lit("\nInfected files: "), text(infected()))
    block = F.concat(F.lit("Scan Started "), F.date_format("ts", "EEE MMM dd HH:mm:ss yyyy"), F.lit("\nKnown viruses: "), text(8000000 + F.col("event_id")), F.lit("\nEngine version: 1.0.1"), F.when(F.col("event_type") != "view", summary).otherwise("\n(interrupted)"))
    return text_files(e, "user_id", ["ts", "event_id"], block)


def clam_runs(spark, sf):
    runs = parsers.block_runs(block_logs(spark, sf))
    return runs.select(F.col("source_file_id").cast("bigint").alias("user_id"), "run_index", dates.iso(F.col("scan_completion_time")).alias("done"), "files_scanned", "threats_detected", "definition_version", "normalized_status")


CLAM_CTE = """
runs AS (SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS run_index,
  strftime(ts, '%Y-%m-%d %H:%M:%S') AS done, ts, CAST(floor(abs(value) * 100) AS BIGINT) AS files_scanned,
  CASE WHEN event_type = 'error' THEN event_id % 4 ELSE 0 END AS threats_detected, CAST(8000000 + event_id AS VARCHAR) AS definition_version
  FROM events WHERE event_type <> 'view')"""
CLAM_SQL = f"WITH {CLAM_CTE} SELECT user_id, run_index, done, files_scanned, threats_detected, definition_version, CASE WHEN threats_detected > 0 THEN 'Completed with detections' ELSE 'Completed clean' END AS normalized_status FROM runs"


def run_ids(spark, sf):
    return parsers.block_runs(block_logs(spark, sf)).select("scan_run_id", F.col("source_file_id").cast("bigint").alias("user_id"), "run_index")


RUN_IDS_SQL = f"WITH {CLAM_CTE} SELECT sha256(concat_ws(':', CAST(user_id AS VARCHAR), 'structured-v2', 'clamwin', 'Unknown', done, CAST(run_index AS VARCHAR)))[1:24] AS scan_run_id, user_id, run_index FROM runs"


def month_filter_fallback(spark, sf):
    runs = parsers.block_runs(block_logs(spark, sf))
    user = F.col("source_file_id").cast("bigint")
    runs = runs.withColumn("month", evidence_month(F.when(user % 2 == 0, "Jan 2024").otherwise("December 2023")))
    kept = verdicts.in_evidence_month(runs, F.col("month"))
    return kept.groupBy(user.alias("user_id")).agg(F.count("*").alias("kept"), F.max(F.when(F.col("month_warning").isNotNull(), 1).otherwise(0)).alias("warned"))


MONTH_SQL = f"""WITH {CLAM_CTE}, m AS (SELECT user_id, CASE WHEN user_id % 2 = 0 THEN year(ts) = 2024 AND month(ts) = 1 ELSE year(ts) = 2023 AND month(ts) = 12 END AS inside FROM runs),
n AS (SELECT user_id, count(*) AS n, count(*) FILTER (inside) AS n_in FROM m GROUP BY user_id)
SELECT user_id, CASE WHEN n_in = 0 THEN n ELSE n_in END AS kept, CASE WHEN n_in < n THEN 1 ELSE 0 END AS warned FROM n"""


def activity_logs(spark, sf):
    e = table(spark, sf, "events")
    line = (
        F.when(F.col("event_type") == "purchase", F.concat(F.date_format("ts", "M/d/yyyy h:mm:ss a"), F.lit("  Scan completed  DOM\\HOST"), text(F.col("user_id")), F.lit("$")))
        .when(F.col("event_type") == "error", F.concat(F.lit("Detections: "), text(F.col("event_id") % 3)))
        .otherwise(F.concat(F.lit("Files scanned: "), text(F.col("event_id"))))
    )
    return text_files(e, "user_id", ["ts", "event_id"], line, head="OnDemandScan ods.activity log\nDAT version: 4954.0\n")


def activity_segments(spark, sf):
    runs = parsers.activity_runs(activity_logs(spark, sf))
    return runs.select(F.col("source_file_id").cast("bigint").alias("user_id"), "run_index", "endpoint", dates.iso(F.col("scan_completion_time")).alias("done"), "files_scanned", "threats_detected", "normalized_status", "definition_version")


ACTIVITY_CTE = """
s AS (SELECT *, coalesce(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seg FROM events),
runs AS (SELECT user_id, CAST(seg AS INTEGER) AS run_index, max(CASE WHEN event_type = 'purchase' THEN ts END) AS ts,
  arg_min(event_id, (ts, event_id)) FILTER (event_type NOT IN ('purchase', 'error')) AS files_scanned, max(CASE WHEN event_type = 'error' THEN event_id % 3 END) AS threats_detected
  FROM s GROUP BY user_id, seg HAVING count(*) FILTER (event_type = 'purchase') > 0)"""
ACTIVITY_SQL = f"""WITH {ACTIVITY_CTE} SELECT user_id, run_index, 'HOST' || user_id AS endpoint, strftime(ts, '%Y-%m-%d %H:%M:%S') AS done, files_scanned, threats_detected,
  CASE WHEN threats_detected > 0 THEN 'Completed with detections' WHEN threats_detected IS NULL THEN 'Completed with warnings' ELSE 'Completed clean' END AS normalized_status, '4954.0' AS definition_version FROM runs"""


def file_verdicts(spark, sf):
    out = verdicts.file_verdicts(parsers.activity_runs(activity_logs(spark, sf)))
    return out.select(F.col("source_file_id").cast("bigint").alias("user_id"), "status", "threat_state", "dat_version", "last_scan", "n_runs", F.size("reasons").cast("bigint").alias("n_reasons"))


VERDICT_SQL = f"""WITH {ACTIVITY_CTE}, f AS (SELECT user_id, bool_or(coalesce(threats_detected > 0, false)) AS pos, bool_or(coalesce(threats_detected = 0, false)) AS zero, bool_or(threats_detected IS NULL) AS open,
  strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_scan, count(*) AS n_runs FROM runs GROUP BY user_id)
SELECT user_id, CASE WHEN pos THEN 'Threats Found' WHEN zero AND NOT open THEN 'Clean' ELSE 'Manual Verification Needed' END AS status,
  CASE WHEN pos THEN 'positive' WHEN zero AND NOT open THEN 'explicit_zero' ELSE 'unknown' END AS threat_state, '4954.0' AS dat_version, last_scan, n_runs, CASE WHEN open THEN 1 ELSE 0 END::BIGINT AS n_reasons FROM f"""


def epo_files(spark, sf):
    rows = table(spark, sf, "lineitem").withColumn("file", F.floor(F.col("l_orderkey") / ORDERS))
    hours = F.when(F.col("l_quantity") < 2, "<1").otherwise(text(F.col("l_quantity"), "int"))
    line = F.concat_ws("  ", F.date_format("l_shipdate", "M/d/yyyy h:mm:ss a"), F.concat(text(4000 + F.col("l_partkey") % 1000), F.lit(".0")), hours, F.concat(F.lit("host-"), text(F.col("l_suppkey"))))
    return text_files(rows, "file", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate"], line, head="On-Demand Full Scan Date   AMCore Content Version   System Name\n")


def epo_rows(spark, sf):
    runs = parsers.epo_rows(epo_files(spark, sf))
    return runs.groupBy("endpoint", "definition_version").agg(F.count("*").alias("n"), F.sum("scan_duration_seconds").alias("seconds"), F.max(dates.iso(F.col("scan_completion_time"))).alias("last"), F.count("threats_detected").alias("known"))


EPO_ROWS_SQL = """SELECT 'HOST-' || l_suppkey AS endpoint, CAST(4000 + l_partkey % 1000 AS VARCHAR) || '.0' AS definition_version, count(*) AS n,
  CAST(sum(CASE WHEN l_quantity < 2 THEN 1800 ELSE CAST(floor(l_quantity) AS BIGINT) * 3600 END) AS BIGINT) AS seconds, strftime(max(l_shipdate), '%Y-%m-%d %H:%M:%S') AS "last", CAST(0 AS BIGINT) AS known FROM lineitem GROUP BY 1, 2"""


def pdf_systems(spark, sf):
    rows = table(spark, sf, "lineitem").withColumn("file", F.floor(F.col("l_orderkey") / ORDERS))
    dat, host = F.concat(text(4000 + F.col("l_partkey") % 1000), F.lit(".5")), F.concat(F.lit("SITE"), text(F.col("l_suppkey") % 7), F.lit("-PD"), text(F.col("l_suppkey")))
    date = F.date_format("l_shipdate", "M/d/yy h:mm:ss a")
    line = F.when(F.col("l_suppkey") % 2 == 0, F.concat_ws(" ", date, host, dat)).otherwise(F.concat_ws(" ", date, dat, F.lit("<1"), host))
    files = text_files(rows, "file", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"], line)
    return parsers.pdf_system_rows(files).select(F.col("source_id").cast("bigint").alias("file"), "name", "dat_version", dates.iso(F.col("last_scan")).alias("last_scan"))


PDF_SQL = f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey // {ORDERS}, l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_shipdate) AS k FROM lineitem)
SELECT CAST(l_orderkey // {ORDERS} AS BIGINT) AS file, 'SITE' || (l_suppkey % 7) || '-PD' || l_suppkey AS name, CAST(4000 + l_partkey % 1000 AS VARCHAR) || '.5' AS dat_version, strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') AS last_scan FROM r WHERE k = 1"""


def epo_total(spark, sf):
    e = table(spark, sf, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("n"), F.max("ts").alias("ts"))
    body = F.concat(F.lit("Number of Threat Events\nGenerated "), F.when(F.col("user_id") % 5 != 0, F.date_format("ts", "M/d/yyyy h:mm:ss a")).otherwise("unknown"), F.lit("\nTotal "), F.format_string("%,d", F.col("n") * 1000 + F.col("user_id")))
    files = e.select(text(F.col("user_id")).alias("source_id"), body.alias("text"))
    runs = parsers.epo_threat_total(files)
    return runs.select(F.col("source_file_id").cast("bigint").alias("user_id"), "threats_detected", dates.iso(F.col("scan_completion_time")).alias("done"), "timestamp_source", "normalized_status")


EPO_TOTAL_SQL = """WITH u AS (SELECT user_id, count(*) FILTER (event_type = 'error') * 1000 + user_id AS n, max(ts) AS ts FROM events GROUP BY user_id)
SELECT user_id, n AS threats_detected, CASE WHEN user_id % 5 <> 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') END AS done, CASE WHEN user_id % 5 <> 0 THEN 'report_generated_time' ELSE 'unknown' END AS timestamp_source,
  CASE WHEN n > 0 THEN 'Completed with detections' ELSE 'Completed clean' END AS normalized_status FROM u"""


def event_csv(spark, sf):
    e = table(spark, sf, "events").withColumn("file", F.floor(F.col("user_id") / PARTIES))
    event = F.when(F.col("event_type") == "click", "Manual Malware Scan Completed").when(F.col("event_type") == "error", "Malware Detected").otherwise("Malware rule updated")
    target = F.concat(F.when(F.col("event_type") == "error", "HOST").otherwise("host"), text(F.col("user_id")), F.lit(" (10.0.0."), text(F.col("user_id") % 250), F.lit(")"))
    explicit = F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("\nThreats detected: "), text(F.col("event_id") % 2))).otherwise("")
    about = F.concat(F.lit('"Scan Type: Quick\nfiles scanned: '), text(F.col("event_id")), explicit, F.lit('\n"'))
    line = F.concat_ws(";", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit("Info"), F.when(F.col("event_type") == "error", "9100").otherwise("9002"), event, F.lit("Agent"), target, F.lit("mgr"), about)
    return text_files(e, "file", ["ts", "event_id", "event_type", "user_id"], line, head="Time;Level;Event ID;Event;Event Origin;Target;Manager;Description\n")


def event_csv_scans(spark, sf):
    runs = parsers.event_runs(csv_rows(event_csv(spark, sf)))
    return runs.select(F.col("source_file_id").cast("bigint").alias("file"), "run_index", "endpoint", dates.iso(F.col("scan_completion_time")).alias("done"), "files_scanned", "threats_detected", F.size("threat_names").cast("bigint").alias("n_names"), "scan_type", "result_basis")


EVENT_SQL = f"""WITH f AS (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY user_id),
c AS (SELECT e.*, coalesce(f.n, 0) AS n FROM events e LEFT JOIN f USING (user_id) WHERE event_type = 'click')
SELECT CAST(user_id // {PARTIES} AS BIGINT) AS file, CAST(row_number() OVER (PARTITION BY user_id // {PARTIES} ORDER BY ts, event_id) - 1 AS INTEGER) AS run_index, 'host' || user_id AS endpoint, strftime(ts, '%Y-%m-%d %H:%M:%S') AS done,
  event_id AS files_scanned, CASE WHEN event_id % 7 = 0 THEN event_id % 2 ELSE n END AS threats_detected, n AS n_names, 'Quick' AS scan_type,
  CASE WHEN event_id % 7 = 0 THEN 'explicit_detection_count' WHEN n > 0 THEN 'trend_csv_detection_events' ELSE 'trend_csv_no_detection_events' END AS result_basis FROM c"""


def generic_csv(spark, sf):
    o = table(spark, sf, "orders").withColumn("file", F.floor(F.col("o_custkey") / PARTIES))
    date = F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")
    status = F.when(F.col("o_orderstatus") == "F", "Scan Complete").when(F.col("o_orderstatus") == "P", "Completed").otherwise("Running")
    count = F.when(F.col("o_orderkey") % 5 == 0, "").otherwise(text(F.col("o_orderkey") % 3))
    line = F.concat_ws("\t", date, date, F.concat(F.lit("PC"), text(F.col("o_custkey"))), status, text(F.col("o_orderkey")), count, F.lit("job"))
    return text_files(o, "file", ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate"], line, head="Started On\tCompleted\tComputer\tStatus\tTotal Files\tInfected\tLogged By\n")


def generic_csv_runs(spark, sf):
    runs = parsers.generic_csv_runs(csv_rows(generic_csv(spark, sf)))
    return runs.select(F.col("source_file_id").cast("bigint").alias("file"), "run_index", "endpoint", dates.iso(F.col("scan_start_time")).alias("started"), "files_scanned", "threats_detected", "normalized_status", "original_status")


GENERIC_SQL = f"""SELECT CAST(o_custkey // {PARTIES} AS BIGINT) AS file, CAST(row_number() OVER (PARTITION BY o_custkey // {PARTIES} ORDER BY o_orderkey) - 1 AS INTEGER) AS run_index, 'PC' || o_custkey AS endpoint,
  strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS started, o_orderkey AS files_scanned, o_orderkey % 3 AS threats_detected, CASE WHEN o_orderkey % 3 > 0 THEN 'Completed with detections' ELSE 'Completed clean' END AS normalized_status,
  CASE WHEN o_orderstatus = 'F' THEN 'Scan Complete' ELSE 'Completed' END AS original_status FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_orderkey % 5 <> 0"""


def symantec_runs(spark, sf):
    e = table(spark, sf, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("n"), F.max("ts").alias("ts"))
    body = F.concat(F.lit("Symantec Endpoint Protection\nVirus definitions: 2024-01-"), text(F.col("user_id")), F.lit("\nRisks found: "), text(F.col("n")), F.when(F.col("user_id") % 3 == 0, "").otherwise(F.concat(F.lit("\nFinished "), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))))
    files = e.select(text(F.col("user_id")).alias("source_id"), body.alias("text"), F.lit(MTIME).cast("timestamp_ntz").alias("mtime"))
    runs = parsers.symantec_runs(files)
    return runs.select(F.col("source_file_id").cast("bigint").alias("user_id"), "threats_detected", dates.iso(F.col("scan_completion_time")).alias("done"), "timestamp_source", "definition_version", F.size("warnings").cast("bigint").alias("n_warnings"))


SYMANTEC_SQL = """WITH u AS (SELECT user_id, count(*) FILTER (event_type = 'error') AS n, max(ts) AS ts FROM events GROUP BY user_id)
SELECT user_id, n AS threats_detected, CASE WHEN user_id % 3 = 0 THEN '2026-05-31 12:00:00' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS done, CASE WHEN user_id % 3 = 0 THEN 'file_mtime_fallback' ELSE 'log_content' END AS timestamp_source,
  '2024-01-' || user_id AS definition_version, CASE WHEN user_id % 3 = 0 THEN 1 ELSE 0 END::BIGINT AS n_warnings FROM u"""

PHRASES = ["McAfee", "AMCore content version", "Number of threat events", "Trend Micro", "manual malware scan started", "ClamWin", "Known viruses", "Infected files: 0", "Symantec", "Risks found", "Virus definitions"]


def classified_documents(spark, sf):
    """Documents with vendor phrases by the bits of their id put in front."""
    d = table(spark, sf, "documents")
    marks = F.concat_ws("\n", *[F.when(F.shiftright("doc_id", i).bitwiseAND(1) == 1, p) for i, p in enumerate(PHRASES)])
    return classify.classified(d.select("doc_id", F.concat_ws("\n", marks, F.coalesce("text", F.lit(""))).alias("text")))


def vendor_scores(spark, sf):
    df = classified_documents(spark, sf)
    return df.select("doc_id", *[F.col("classification.scores")[v].cast("bigint").alias(v) for v in classify.VENDORS])


def vendor_decision(spark, sf):
    c = F.col("classification")
    return classified_documents(spark, sf).select("doc_id", c["vendor"].alias("vendor"), (c["confidence"] * 1000).cast("bigint").alias("confidence_permille"), F.size(c["conflicts"]).cast("bigint").alias("n_conflicts"), c["requires_review"].alias("requires_review"))


def _scores_cte() -> str:
    text = " || ".join(["''", *[f"CASE WHEN (doc_id >> {i}) & 1 = 1 THEN '{p}' || chr(10) ELSE '' END" for i, p in enumerate(PHRASES)], "coalesce(text, '')"])
    score = lambda v: " + ".join(["0", *[f"CASE WHEN regexp_matches(t, '(?is){p}') THEN {w} ELSE 0 END" for name, p, w, _ in classify.RULES if name == v]])
    return f"d AS (SELECT doc_id, {text} AS t FROM documents), s AS (SELECT doc_id, {', '.join(f'CAST({score(v)} AS BIGINT) AS {v}' for v in classify.VENDORS)} FROM d)"


SCORES_SQL = f"WITH {_scores_cte()} SELECT * FROM s"
DECISION_SQL = f"""WITH {_scores_cte()}, u AS (UNPIVOT s ON clamwin, generic_antivirus, symantec, trellix_mcafee, trend_micro INTO NAME vendor VALUE score),
r AS (SELECT doc_id, vendor, score, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, vendor) AS k, sum(score) OVER (PARTITION BY doc_id) AS total FROM u),
t AS (SELECT doc_id, max(CASE WHEN k = 1 THEN vendor END) AS v1, max(CASE WHEN k = 1 THEN score END) AS s1, max(CASE WHEN k = 2 THEN score END) AS s2, max(total) AS total, count(*) FILTER (k > 1 AND score >= 5) AS rivals FROM r GROUP BY doc_id)
SELECT doc_id, CASE WHEN s1 < 5 THEN 'unknown' WHEN s2 >= 5 AND s1 - s2 <= 2 THEN 'ambiguous' ELSE v1 END AS vendor,
  CAST(floor((CASE WHEN s1 < 5 THEN 0 WHEN s2 >= 5 AND s1 - s2 <= 2 THEN round(s1 / total, 3) ELSE round(least(1.0, s1 / 12), 3) END) * 1000) AS BIGINT) AS confidence_permille,
  CASE WHEN s1 < 5 THEN 0 WHEN s2 >= 5 AND s1 - s2 <= 2 THEN 2 ELSE rivals END AS n_conflicts, s1 < 5 OR (s2 >= 5 AND s1 - s2 <= 2) AS requires_review FROM t"""


QUERIES = {
    "clam_runs": clam_runs,
    "run_ids": run_ids,
    "month_filter_fallback": month_filter_fallback,
    "activity_segments": activity_segments,
    "file_verdicts": file_verdicts,
    "epo_rows": epo_rows,
    "epo_total": epo_total,
    "pdf_system_rows": pdf_systems,
    "event_csv_scans": event_csv_scans,
    "generic_csv_runs": generic_csv_runs,
    "symantec_runs": symantec_runs,
    "vendor_scores": vendor_scores,
    "vendor_decision": vendor_decision,
}
ORACLES = {
    "clam_runs": CLAM_SQL,
    "run_ids": RUN_IDS_SQL,
    "month_filter_fallback": MONTH_SQL,
    "activity_segments": ACTIVITY_SQL,
    "file_verdicts": VERDICT_SQL,
    "epo_rows": EPO_ROWS_SQL,
    "epo_total": EPO_TOTAL_SQL,
    "pdf_system_rows": PDF_SQL,
    "event_csv_scans": EVENT_SQL,
    "generic_csv_runs": GENERIC_SQL,
    "symantec_runs": SYMANTEC_SQL,
    "vendor_scores": SCORES_SQL,
    "vendor_decision": DECISION_SQL,
}
