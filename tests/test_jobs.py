"""Listing by executors, one scan at a time, results by batch, checklists read once, audit, and small helpers."""

import threading
import time

import pytest
from pyspark.sql import functions as F

from palisade.functions import versions
from palisade.operators import checklist, explore, matching, ocr, second_reader
from palisade.sources import evidence, listing, state
from palisade.streaming import ingest
from palisade.streaming.jobs import ScanCancelled, ScanJobs, ScanRunning
from palisade.workspace import Workspace
from test_evidence import book, box, images


def test_listing_sees_hidden_looking_and_empty_files(spark, tmp_path):
    for month, name, text in (("May 2026", "NET/_x.txt", "Nothing found"), ("May 2026", "NET/empty.log", ""), ("May 2026", "NET/deep/er/100% +.txt", "y"), ("May 2026", "_folder/z.csv", "a,b"), ("Jun 2026", "b.txt", "b")):
        path = tmp_path / month / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    (tmp_path / "top.txt").write_text("top")
    got = {r.path: (r.length, bytes(r.content)) for r in evidence.evidence_files(spark, str(tmp_path)).collect()}
    assert got == {"May 2026/NET/_x.txt": (13, b"Nothing found"), "May 2026/NET/empty.log": (0, b""), "May 2026/NET/deep/er/100% +.txt": (1, b"y"), "May 2026/_folder/z.csv": (3, b"a,b"), "Jun 2026/b.txt": (1, b"b"), "top.txt": (3, b"top")}
    assert {r.path for r in evidence.evidence_files(spark, f"file://{tmp_path}", include_empty=False, months=["May 2026"]).collect()} == {p for p in got if p.startswith("May")} - {"May 2026/NET/empty.log"} | {"top.txt"}
    assert {r.path for r in evidence.evidence_files(spark, str(tmp_path), most_bytes=3).collect()} == set(got) - {"May 2026/NET/_x.txt"}
    assert evidence.evidence_files(spark, str(tmp_path / "none")).collect() == []
    assert {r.path for r in evidence.spark_files(spark, str(tmp_path / "Jun 2026"), 100, True).collect()} == {"b.txt"}


def test_listing_of_many_files_is_dealt_out(spark, tmp_path):
    for k in range(20):
        (tmp_path / f"May 2026/S{k}").mkdir(parents=True)
        for i in range(500):
            (tmp_path / f"May 2026/S{k}/f{i}.txt").touch()
    files = listing.listed(spark, str(tmp_path))
    assert files.count() == 10_000 and files.rdd.getNumPartitions() == 22  # a folder each, the month and the top


def test_one_scan_at_a_time_and_cancelling(spark, tmp_path):
    jobs, target = ScanJobs(spark, str(tmp_path / "state")), str(tmp_path / "entries")
    first = jobs.run("May 2026", lambda step: spark.range(3), target)
    assert jobs.progress()["status"] == "completed" and jobs.active() is None and state.current(spark, target) == first
    began, seen = threading.Event(), {}

    def slow(step):
        began.set()
        return spark.range(0, 400, 1, 400).where(F.udf(lambda x: time.sleep(1) or True, "boolean")("id"))

    def run():
        try:
            jobs.run("Jun 2026", slow, target)
        except ScanCancelled as error:
            seen["error"] = error

    thread = threading.Thread(target=run)
    thread.start()
    began.wait(60)
    with pytest.raises(ScanRunning):
        ScanJobs(spark, str(tmp_path / "state")).run("May 2026", lambda step: spark.range(1), target)
    assert not jobs.release_stale(3600)
    time.sleep(2)
    assert jobs.cancel()
    thread.join(60)
    assert not thread.is_alive() and "error" in seen
    assert (jobs.progress()["status"], jobs.progress()["month"]) == ("cancelled", "Jun 2026")
    assert state.current(spark, target) == first and spark.read.parquet(first).count() == 3
    assert not jobs.cancel()
    with pytest.raises(ZeroDivisionError):
        jobs.run("May 2026", lambda step: 1 / 0, target)
    assert jobs.progress()["status"] == "failed" and jobs.active() is None
    assert jobs._create("lease", '{"job_id": "dead", "began": 0}') and not jobs._create("lease", "{}")
    assert jobs.release_stale(60) and jobs.run("May 2026", lambda step: spark.range(5), target) == state.current(spark, target)


def test_batches_are_written_once_over_restarts(spark, tmp_path):
    root, out, checkpoint = tmp_path / "evidence", str(tmp_path / "out"), str(tmp_path / "checkpoint")
    (root / "May 2026/NET").mkdir(parents=True)
    add = lambda name, text="x": (root / "May 2026/NET" / name).write_text(text)
    run = lambda: ingest.start_inventory(ingest.evidence_stream(spark, str(root), 2), out, checkpoint, str(root)).awaitTermination()
    for i in range(5):
        add(f"a{i}.txt")
    run()
    assert ingest.inventory_files(spark, out).count() == 5
    # a run that wrote its batch but died before the checkpoint knew: the same batch comes again, over its rows
    last = max(int(p.name) for p in (tmp_path / "checkpoint/commits").iterdir() if p.name.isdigit())
    for name in (str(last), f".{last}.crc"):
        (tmp_path / "checkpoint/commits" / name).unlink(missing_ok=True)
    run()
    add("b.txt", "yy")
    run()
    files = ingest.inventory_files(spark, out).collect()
    assert sorted(r.path.rsplit("/", 1)[-1] for r in files) == ["a0.txt", "a1.txt", "a2.txt", "a3.txt", "a4.txt", "b.txt"] and len({r.batch for r in files}) == 4
    assert [(r.system, r.kind, r.n, r.bytes) for r in ingest.inventory_tallies(spark, out).collect()] == [("NET", "text", 6, 7)]


def test_audit_stream_goes_on_after_a_restart(spark, tmp_path):
    source, out, checkpoint = tmp_path / "events", str(tmp_path / "audit"), str(tmp_path / "checkpoint")
    rows = lambda a, b: spark.range(a, b).selectExpr("timestamp'2026-05-01' + make_interval(0, 0, 0, 0, 0, 0, id) as ts", "'scan' as event", "concat('u', id % 2) as actor", "map('id', string(id)) as details")
    for a, b in ((0, 4), (4, 7)):
        rows(a, b).coalesce(1).write.mode("append").parquet(str(source))
        ingest.start_audit(spark.readStream.schema(rows(0, 1).schema).parquet(str(source)), out, checkpoint).awaitTermination()
    audit = state.read_audit(spark, out)
    assert audit.count() == 7
    assert {(r.actor, r.details["id"], r.k) for r in state.audit_tail(audit, 2).collect()} == {("u0", "6", 1), ("u0", "4", 2), ("u1", "5", 1), ("u1", "3", 2)}
    assert "WindowGroupLimit" in state.audit_tail(audit, 2)._jdf.queryExecution().executedPlan().toString()


def test_checklist_is_read_once(spark, tmp_path):
    root = tmp_path / "evidence"
    month = root / "May 2026"
    (month / "NET").mkdir(parents=True)
    (month / "NET/a.txt").write_text("Nothing found")
    (month / "checklist May 2026.xlsx").write_bytes(b"no zip")
    w = Workspace(spark, str(root), str(tmp_path / "state"))
    cells, reason = w.checklist("May 2026")
    assert cells is None and "BadZipFile" in reason
    with pytest.raises(ValueError, match="BadZipFile"):
        w.system_tree("May 2026")
    book(month / "checklist May 2026.xlsx")
    versions_kept = lambda: sorted(str(p) for p in (tmp_path / "state/checklists").glob("*/v-*"))
    first = w.cells("May 2026").collect()
    kept = versions_kept()
    assert first and len(kept) == 2  # the broken book's reason, and this one's cells
    assert w.cells("May 2026").collect() == first and w.logs("May 2026")["summary"].first() and versions_kept() == kept
    with open(month / "checklist May 2026.xlsx", "ab") as f:
        f.write(b"\0")  # another book by its bytes
    assert w.cells("May 2026") is not None and len(versions_kept()) == 3
    assert w.scanned("May 2026") is None
    w.scan("May 2026")
    assert [r.path for r in w.scanned("May 2026").collect()] == ["May 2026/NET/a.txt"]
    w.clear_caches("me")
    assert not versions_kept() and [(r.event, r.actor) for r in w.audit().collect()] == [("cache.cleared", "me")]


def test_pages_fall_back_to_their_largest_image(spark):
    pages = spark.createDataFrame([("s", 2, " short "), ("s", 1, "a page with a text of its own"), ("s", 3, None), ("s", 4, "")], "source_id string, page_no int, native_text string")
    pictures = spark.createDataFrame([("s", 2, 0, 10, 10, ["small"]), ("s", 2, 1, 20, 10, ["large", "one"]), ("s", 2, 2, 10, 20, ["as large"]), ("s", 1, 0, 9, 9, ["not read"]), ("s", 4, 0, 5, 5, [])], "source_id string, page_no int, image_no int, width int, height int, tokens array<string>")
    r = evidence.pdf_text(evidence.with_page_images(pages, pictures)).first()
    assert r.text == "a page with a text of its own\nlarge\none" and r.used_ocr
    assert r.warnings == [f"PDF page {n} has insufficient native text and was not OCR-scanned." for n in (3, 4)]


def test_panels_grow_over_near_boxes(spark):
    heading = (box(300, 100, 100), "Scan Summary", 0.9)
    shots = {
        "grown": [(box(200, 100, 70), "left", 0.9), heading, (box(430, 101, 50), "near", 0.9), (box(515, 100, 50), "next", 0.9), (box(640, 100, 50), "far", 0.9)],
        "label": [heading, (box(300, 130, 90), "Detections: 3", 0.9)],
        "none": [(box(0, 0), "Files scanned", 0.9)],
        "two": [heading, (box(300, 300, 100), "mfetp ods.activity", 0.9)],
    }
    got = {}
    for r in ocr.panels(images(spark, **shots)).collect():
        got.setdefault(r.image, []).append((r.panel_no, r.x0, r.y0, r.x1, r.y1, r.height))
    assert got == {"grown": [(0, 185, 95, 580, 145, 10)], "two": [(0, 285, 95, 415, 145, 10), (1, 285, 295, 415, 345, 10)]}


def test_counts_belong_to_the_nearest_label(spark):
    """Each label of a table of two columns has its own number; the confidences share one placing."""
    shots = [(box(0, 0), "Detections", 0.95), (box(80, 0, 10), "4", 0.6), (box(200, 0), "Memory", 0.95), (box(280, 0, 10), "9", 0.95), (box(0, 40), "Infected files", 0.95), (box(80, 41, 10), "2", 0.95)]
    got = {r.strictness: (r.threat_result, r.candidate_result) for r in ocr.audits(images(spark, a=shots), ("high", "low")).collect()}
    assert got == {"high": ("positive", "positive"), "low": ("positive", "positive")}
    rows = ocr.rows_of(ocr.boxes_of(shots))
    assert ocr.spatial_counts(rows, 0.9)[1:] == ([("Infected files", 2)], True)
    assert sorted(ocr.spatial_counts(rows, 0.5)[1]) == [("Detections ", 4), ("Infected files", 2)]


def test_candidates_are_all_pairs_that_score(spark):
    """The index against the score of every pair, with keys inside texts, texts inside keys, and token-only pairs."""
    logs = spark.createDataFrame([("m/a1.log", "x", "FW", "s"), ("m/srv07 east.log", "[FW/HQ] srv07 east", "FW", "HQ"), ("m/zz alpha beta gamma.log", "alpha beta gamma", "NET", "d"), ("m/q.txt", "q", "NET", "")], "path string, display string, system string, subsystem string")
    rows = [("1", "FW", "HQ", "FW srv07", "box-7", ["srv07", "east"]), ("2", "FW", "s", "fws a1x fwsa1x tail", "", ["s"]), ("3", "NET", "", "zeta", "omega", ["alpha", "beta", "gamma", "delta"]), ("4", "NET", "Far", "7", "q", []), ("5", "FW", "", "", "", ["srv07", "east", "hq"])]
    table = spark.createDataFrame(rows, "id string, system string, location string, item string, pc_name string, tokens array<string>")
    edges = {(r.path, r.row_id): r.score for r in matching.match_edges(logs, table).collect()}
    keys, (named, values) = matching.log_keys(logs), matching.row_values(table)
    points = keys.crossJoin(values.withColumnRenamed("system", "s")).where("system = s").withColumn("points", matching.value_points())
    points = {(r.path, r.vid): r.points for r in points.collect()}
    tokens = {r.path: set(r.log_tokens) for r in keys.collect()}
    system = {r.path: r.system for r in keys.collect()}
    want = {}
    for r in named.join(table.select("id", F.col("system").alias("s")), F.col("row_id") == F.col("id")).collect():
        for path, t in tokens.items():
            if system[path] == r.s:
                score = sum(points.get((path, v), 0) for v in (r["loc"], r.item, r.pc_name)) + 3 * min(6, len(t & set(r.tokens)))
                if score >= 8:
                    want[path, r.row_id] = score
    assert edges == want and ("m/zz alpha beta gamma.log", "3") in want and ("m/srv07 east.log", "5") in want


def test_small_helpers(spark):
    one = lambda *cs: tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cs)]).first())
    lit = F.lit
    assert one(state.clamped(lit(0.2), 0.5, 0.99), state.clamped(lit(2.0), 0.5, 0.99), state.clamped(lit(0.7), 0.5, 0.99)) == (0.5, 0.99, 0.7)
    assert one(versions.same_version(lit("6000.0 (x)"), lit("6000")), versions.same_version(lit("6000"), lit("6001")), versions.same_version(lit("none"), lit("6000"))) == (True, False, False)
    assert one(*[state.portable_path(lit(p), "C:\\logs\\") for p in ("C:\\logs\\May\\a.txt", "D:\\other\\b.txt", "/abs/c.txt", "May/d.txt")]) == ("May/a.txt", "b.txt", "c.txt", "May/d.txt")
    keys = one(second_reader.cache_key(lit("h"), "m", "p", 960), second_reader.cache_key(lit("h"), "m", "p", 961), second_reader.cache_key(lit(None).cast("string"), "m", "p", 960))
    assert len(set(keys)) == 3 and all(len(k) == 64 for k in keys)
    pointers = spark.createDataFrame([("a", "h1"), ("b", "h2"), ("c", None)], "path string, content_sha256 string")
    contents = spark.createDataFrame([("h1", "t1")], "content_sha256 string, found string")
    assert [(r.path, r.found) for r in state.cached_results(pointers, contents).collect()] == [("a", "t1")] and state.cleared(contents).collect() == []
    tokens = spark.sql("SELECT 'a' AS image, array(named_struct('bbox', array(array(1.0D)))) AS t UNION ALL SELECT 'b', array(named_struct('bbox', CAST(NULL AS array<array<double>>))) UNION ALL SELECT 'c', filter(array(named_struct('bbox', array(array(1.0D)))), x -> false)")
    assert {r.image: r.ok for r in tokens.select("image", ocr.usable(F.col("t")).alias("ok")).collect()} == {"a": True, "b": False, "c": True}
    systems = F.array(F.struct(lit("A").alias("name")), F.struct(lit("B").alias("name")))
    assert one(explore.selected_system(systems, lit("B"))["name"], explore.selected_system(systems, lit("Z"))["name"]) == ("B", "A")
    tree = spark.createDataFrame([("NET", "HQ East", 3, 1, 2, 0), ("NET", "Depot", 1, 1, 0, 0), ("FW", "x", 2, 0, 0, 2)], "system string, location string, expected long, found long, missing long, unresolved_count long")
    assert {tuple(r) for r in explore.node_totals(tree).collect()} == {("NET", 4, 2, 2, 0), ("FW", 2, 0, 0, 2)}
    shown = spark.createDataFrame([("[NET/hq-EAST] a.png", "NET"), ("b.png", "NET")], "display string, system string")
    assert [(r.display, r.location) for r in explore.overlay(shown, tree).collect()] == [("[NET/hq-EAST] a.png", "HQ East")]
    rows = spark.createDataFrame([("NET", 2, 1), ("FW", 1, 9), ("NET", 1, 3)], "system string, sheet_pos int, row int")
    assert [r.system for r in checklist.system_order(rows).orderBy("first_row").collect()] == ["NET", "FW"]
    queue = spark.createDataFrame([("a.png", "PNG", "Manual Verification Needed"), ("b.txt", "TXT", "Manual Verification Needed"), ("c.png", "PNG", "Clean")], "path string, type string, status string")
    assert [r.path for r in explore.ai_review_queue(queue).collect()] == ["a.png"]


def test_complete_screenshots(spark):
    """Strong, placed tokens and every field settled; one weak token is enough to doubt."""
    good = [(box(0, 0, 90), "DAT version 6100.0", 0.95), (box(0, 30, 90), "Detections: 0", 0.95), (box(0, 60, 200), "Scan completed 2026-05-04 10:00:00", 0.95)]
    weak = [*good[:2], (*good[2][:2], 0.5)]
    got = {r.image: r.ok for r in ocr.audits(images(spark, good=good, weak=weak)).select("image", ocr.complete().alias("ok")).collect()}
    assert got == {"good": True, "weak": False}
