import csv
import itertools

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from palisade.functions import dates
from palisade.functions.text import evidence_month
from palisade.operators import classify, parsers, verdicts
from palisade.sources.evidence import csv_rows, decode, read_csv

CLAM = """Scan Started Mon May 04 10:00:00 2026
Known viruses: 8000001
Engine version: 1.0.1
----------- SCAN SUMMARY -----------
Scanned files: 1,204
Infected files: 0
Scan Started Tue May 05 11:00:00 2026
(interrupted)
Scan Started Wed May 06 12:00:00 2026
----------- SCAN SUMMARY -----------
Scanned files: 7
Infected files: 2
"""


def files(spark, **texts):
    df = spark.createDataFrame(list(texts.items()), "source_id string, text string")
    return df.withColumn("mtime", F.lit("2026-05-31 12:00:00").cast("timestamp_ntz"))


def run_list(df):
    return [(r.run_index, r.done, r.files_scanned, r.threats_detected, r.definition_version) for r in df.withColumn("done", dates.iso(F.col("scan_completion_time"))).orderBy("source_file_id", "run_index").collect()]


def test_blocks(spark):
    runs = parsers.block_runs(files(spark, a=CLAM))
    assert run_list(runs) == [(0, "2026-05-04 10:00:00", 1204, 0, "8000001"), (1, "2026-05-06 12:00:00", 7, 2, None)]
    v = verdicts.file_verdicts(runs).first()
    assert (v.status, v.dat_version, v.last_scan) == ("Threats Found", "Unknown", "2026-05-06 12:00:00")


def test_blocks_without_header_or_date(spark):
    bare = "----------- SCAN SUMMARY -----------\nInfected files: 0"
    bad = "Scan Started Foo May 04 10:00:00 2026\n" + bare
    runs = parsers.block_runs(files(spark, a=bare, b=bad)).collect()
    assert {(r.timestamp_source, len(r.warnings)) for r in runs} == {("file_mtime_fallback", 1)} and len(runs) == 2


def test_activity(spark):
    head = "McAfee VirusScan Enterprise\nAnti-virus DAT version = 4954.0\n"
    one = head + "Files scanned: 10\nDetections: 3\n6/9/2026 1:07:52 AM Scan completed DOM\\HOST1$\nDetections: 9"
    two = head + "Nothing found\n6/9/2026 1:00:00 AM Scan completed (0:01:30)\nFiles not scanned: 4\nDetections: 0\n6/9/2026 2:00:00 AM Full scan? Scan complete HOST2\\Administrator quick scan\n"
    three = head + "6/9/2026 1:00:00 AM scan completed"
    runs = {(r.source_file_id, r.run_index): r for r in parsers.activity_runs(files(spark, a=one, b=two, c=three)).collect()}
    assert len(runs) == 4
    a, b0, b1, c = runs["a", 0], runs["b", 0], runs["b", 1], runs["c", 0]
    assert (a.endpoint, a.threats_detected, a.normalized_status, a.definition_version) == ("HOST1", 3, "Completed with detections", "4954.0")
    assert (b0.threats_detected, b0.normalized_status, b0.scan_duration_seconds) == (0, "Completed clean", 90)
    assert (b1.endpoint, b1.scan_type, b1.files_skipped, b1.normalized_status) == ("HOST2", "Quick Scan", 4, "Completed with warnings")
    assert c.threats_detected is None and c.normalized_status == "Completed with warnings"
    got = {r.source_file_id: r.status for r in verdicts.file_verdicts(parsers.activity_runs(files(spark, b=two, c=three))).collect()}
    assert got == {"b": "Clean", "c": "Manual Verification Needed"}


def test_epo(spark):
    head = "On-Demand Full Scan Date AMCore Content Version System Name\n"
    rows = "6/9/2026 1:07:52 AM 4954.0 <1 host01\n6/9/2026 1:08:52 AM 4954.0 2.5 h2\n6/9/2026 1:09:52 AM 500.0 1 h3\nother"
    runs = parsers.epo_rows(files(spark, a=head + rows, b=rows)).orderBy("run_index").collect()
    assert [(r.endpoint, r.scan_duration_seconds, r.definition_version, r.threats_detected) for r in runs] == [("HOST01", 1800, "4954.0", None), ("H2", 9000, "4954.0", None), ("H3", 3600, None, None)]
    total = parsers.epo_threat_total(files(spark, a="Number of Threat Events\nTotal 0", b="number of threat events total 1,204 at 6/9/2026 1:07:52 AM", c="Number of Threat Events"))
    assert {r.source_file_id: (r.threats_detected, r.timestamp_source) for r in total.collect()} == {"a": (0, "unknown"), "b": (1204, "report_generated_time")}


def test_pdf_rows_keep_the_first(spark):
    text = "6/9/26 1:07:52 AM HOST01 4954.0 1.1.1.1\n6/9/26 3:03:39 AM 4042.0 1 SITE-A-PD11\n6/9/26 9:00:00 AM HOST01 5000.0\n6/9/26 9:00:00 AM Total 5000.0"
    got = {r.name: r.dat_version for r in parsers.pdf_system_rows(files(spark, a=text)).collect()}
    assert got == {"HOST01": "4954.0", "SITE-A-PD11": "4042.0"}


HEAD = "Time;Level;Event ID;Event;Event Origin;Target;Manager;Description\n"


def test_events(spark):
    done = "2026-05-04 10:00:00;Info;9002;Manual Malware Scan Completed;Agent;host1 (10.0.0.1);m;"
    a = HEAD + done + '"Scan Type: Full.\nscan time: 5"\n2026-05-04 11:00:00;Warn;9100;Malware Detected;Agent;HOST1;m;x\n2026-05-04 12:00:00;Info;1;Malware rule updated;Agent;host1;m;x\n' + done + "y\n"
    b = (HEAD + done + "Threats detected: 0\n2026-05-04 11:00:00;Warn;9100;Virus found;Agent;host1;m;x\n").replace(";", "\t")
    runs = {(r.source_file_id, r.run_index): r for r in parsers.event_runs(csv_rows(files(spark, a=a, b=b))).collect()}
    assert [(runs["a", k].endpoint, runs["a", k].threats_detected, runs["a", k].threat_names) for k in (0, 1)] == [("host1", 1, ["Malware Detected"])] * 2
    assert (runs["a", 0].scan_type, runs["a", 0].scan_duration_seconds, runs["b", 0].threats_detected, runs["b", 0].result_basis) == ("Full", 5, 0, "explicit_detection_count")


def test_generic_csv(spark):
    rows = "Started On,Completed,Computer,Status,Total Files,Infected,Logged By\n,2026-05-04 10:00:00,PC1,Scan Complete,10,0,job\n,,PC2,Scan Complete,1,,job\n,,PC3,Running,1,1,job\n,bad,PC4,Completed,\"1,000\",2,\n"
    runs = parsers.generic_csv_runs(csv_rows(files(spark, a=rows))).orderBy("run_index").collect()
    assert [(r.run_index, r.endpoint, r.threats_detected, r.files_scanned, r.scan_type, len(r.warnings)) for r in runs] == [(0, "PC1", 0, 10, "job", 0), (1, "PC4", 2, 1000, "Antivirus scan", 1)]


def test_csv_shapes():
    headers, delimiter, rows = read_csv(" a ,b\n1,2\n3\n4,5,6\n")
    assert (headers, delimiter) == (["a", "b"], ",") and rows[1] == {"a": "3", "b": ""} and rows[2][""] == "['6']"
    assert read_csv("")[0] == []


def test_decode():
    assert decode(b"\xef\xbb\xbfhi") == ("hi", "utf-8-sig", [])
    assert decode("hé".encode("utf-16"))[:2] == ("hé", "utf-16")
    assert decode(b"a\xe9b")[:2] == ("aéb", "cp1252")
    assert decode(b"\x81\x8d\x90")[1] == "utf-8-replace"


def test_classification(spark):
    df = files(spark, clam="ClamWin\nKnown viruses: 1\nInfected files: 0", both="McAfee\nSymantec", none="hello", csv="x")
    df = df.withColumn("headers", F.when(F.col("source_id") == "csv", F.split(F.lit("Started On|Completed|Computer|Status|Total Files|Infected"), r"\|")))
    got = {r.source_id: r.classification for r in classify.classified(df, "text", "headers").collect()}
    assert (got["clam"].vendor, got["clam"].confidence, got["clam"].requires_review) == ("clamwin", 1.0, False)
    assert got["both"].vendor == "ambiguous" and got["both"].conflicts == ["symantec", "trellix_mcafee"]
    assert got["none"].vendor == "unknown" and got["csv"].vendor == "generic_antivirus" and got["csv"].confidence == 0.5


def month_case(spark, *runs):
    df = spark.createDataFrame([("f", i, d, t, "v") for i, (d, t) in enumerate(runs)], "source_file_id string, run_index int, d string, threats_detected long, definition_version string")
    df = df.select("*", F.col("d").cast("timestamp_ntz").alias("scan_completion_time"), F.lit(None).cast("timestamp_ntz").alias("scan_start_time"), F.lit("").alias("normalized_status"), F.array().cast("array<string>").alias("warnings"))
    kept = verdicts.in_evidence_month(df, evidence_month(F.lit("May 2026")))
    return kept.count(), kept.where("month_warning is not null").count() > 0, verdicts.file_verdicts(kept).first().status


def test_month_filter(spark):
    may, april = "2026-05-04 10:00:00", "2026-04-04 10:00:00"
    assert month_case(spark, (may, 0), (april, 2)) == (1, True, "Clean")
    assert month_case(spark, (april, 2)) == (1, True, "Threats Found")
    assert month_case(spark, (None, 0), (april, 1)) == (1, True, "Clean")
    assert month_case(spark, (may, 0), (may, None)) == (2, False, "Manual Verification Needed")


def test_never_clean_with_an_unknown(spark):
    cases = list(itertools.chain.from_iterable(itertools.product([None, 0, 1], repeat=n) for n in (1, 2, 3, 4)))
    df = spark.createDataFrame([(str(k), i, t) for k, counts in enumerate(cases) for i, t in enumerate(counts)], "source_file_id string, run_index int, threats_detected long")
    df = df.select("*", F.lit(None).cast("timestamp_ntz").alias("scan_completion_time"), F.lit(None).cast("timestamp_ntz").alias("scan_start_time"), F.lit("x").alias("definition_version"), F.lit("").alias("normalized_status"), F.array().cast("array<string>").alias("warnings"))
    got = {int(r.source_file_id): r.status for r in verdicts.file_verdicts(df).collect()}
    assert got == {k: "Threats Found" if any(c) else "Clean" if None not in c else "Manual Verification Needed" for k, c in enumerate(cases)}


words = st.text(st.sampled_from("abé ,;|\t\"\n\x00\ud7ff"), max_size=40)


@settings(max_examples=200, deadline=None)
@given(words, st.binary(max_size=40))
def test_readers_never_fail(text, data):
    assert isinstance(decode(data)[0], str)
    try:
        headers, _, rows = read_csv(text)
    except csv.Error:
        return
    assert all(isinstance(v, str) for r in rows for v in r.values())
