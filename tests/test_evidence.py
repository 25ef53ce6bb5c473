import datetime
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from palisade.operators import checklist, coverage, matching, ocr, paths, reconcile
from palisade.operators import scan_text as T
from palisade.plans import inventory, report
from palisade.sources import state
from palisade.sources.evidence import content_error, evidence_files, pdf_text
from palisade.sources.workbook import WorkbookSource
from palisade.streaming import ingest

PATHS = [
    ("RADIO/HQ/a.png", "RADIO", "HQ", "[RADIO/HQ] a.png"),
    ("RADIO/a.png", "RADIO", "Base System", "[RADIO] a.png"),
    ("radio/site/ABC 1.png", "RADIO", "Site Radio", "[radio/site] ABC 1.png"),
    ("ePO Report Combined/info.pdf", "INFO", "Report", "[ePO Report Combined] info.pdf"),
    ("ePO Report Combined/x.pdf", "Uncategorized", "Report", "[ePO Report Combined] x.pdf"),
    ("Voice Report/v.csv", "VOICE", "Site U", "[Voice Report] v.csv"),
    ("Depot Screenshot/HQ Screenshot/CCTV/c.png", "CCTV", "HQ", "[Depot Screenshot/HQ Screenshot/CCTV] c.png"),
    ("HQ Screenshot/HQ CCTV/c.png", "CCTV", "HQ", "[HQ Screenshot/HQ CCTV] c.png"),
    ("old radio epm.log", "RADIO", "Unspecified", "old radio epm.log"),
    ("misc.log", "Uncategorized", "Base System", "misc.log"),
]


def test_paths(spark):
    names = [(f"May 2026/{p}",) for p, *_ in PATHS] + [(f"May 2026/{p}",) for p in (".hidden.txt", "Thumbs.db", "a.docx", "../x.log")]
    got = {r.path: (r.system, r.subsystem, r.display) for r in paths.inventory(spark.createDataFrame(names, "path string")).collect()}
    assert got == {f"May 2026/{p}": tuple(rest) for p, *rest in PATHS}


def test_months_newest_first(spark):
    df = spark.createDataFrame([("Jan 2026/a.log",), ("December 2025/a.log",), ("May 2026/a.log",), ("notes/a.log",)], "path string")
    assert [r.month for r in paths.months(df).collect()] == ["May 2026", "Jan 2026", "December 2025", "notes"]


def test_content_errors(spark):
    rows = [("a.pdf", b"%PDF-1"), ("a.pdf", b"x"), ("a.png", b"\x89PNG\r\n\x1a\nxx"), ("a.jpg", b"x"), ("a.txt", b""), ("a.txt", b"a\0b"), ("a.txt", b"\xff\xfea\0"), ("a.log", b" \n\t"), ("a.csv", b"a,b\n1,2"), ("a.txt", b"\x30\x00\x32"), ("a.txt", b"00 20")]
    df = spark.createDataFrame([(i, p, bytearray(c)) for i, (p, c) in enumerate(rows)], "i int, path string, content binary")
    got = [r.e is None for r in df.select("i", content_error(F.col("path"), F.col("content")).alias("e")).orderBy("i").collect()]
    assert got == [True, False, True, False, False, False, True, False, True, False, True]


def test_pdf_pages(spark):
    rows = [("a", 2, "", ["seen", "text"]), ("a", 1, "x" * 30, []), ("b", 1, "short", [])]
    got = {r.source_id: r for r in pdf_text(spark.createDataFrame(rows, "source_id string, page_no int, native_text string, image_tokens array<string>")).collect()}
    assert got["a"].text == "x" * 30 + "\nseen\ntext" and got["a"].used_ocr and got["a"].warnings == []
    assert got["b"].text == "" and len(got["b"].warnings) == 1


CELLS = [
    ("RADIO", 0, 1, ["title"]), ("RADIO", 0, 3, ["Location", "System", "Host Name", "DAT Version", "Remarks", "Remarks 2", "AV Software"]),
    ("RADIO", 0, 4, ["HQ", "RADIO 1", "pc1", "55", "a", "b", ""]), ("RADIO", 0, 5, ["HQ", "RADIO 2", "pc2", "", "", "", "Other"]), ("RADIO", 0, 6, ["", "", "x"]),
    ("RADIO 2", 1, 2, ["System", "Location", "Hostname"]), ("RADIO 2", 1, 3, ["RADIO 1", "HQ", "pc1"]), ("RADIO 2", 1, 4, ["RADIO 2", "HQ", "pc2"]),
    ("CCTV", 2, 1, ["Location", "System"]), ("CCTV", 2, 2, ["HQ", "c"]), ("CCTV 2", 3, 1, ["Location", "System"]), ("CCTV 2", 3, 2, ["HQ", "c"]),
    ("Late", 4, 13, ["Location", "System"]), ("Late", 4, 14, ["HQ", "c"]), ("Global Checklist", 5, 1, ["Location", "System"]), ("Global Checklist", 5, 2, ["HQ", "c"]),
    ("NET", 6, 1, ["Location", "System"]), ("NET", 6, 2, ["", "FW 1"]),
]


def test_checklist(spark):
    rows = checklist.checklist_rows(spark.createDataFrame(CELLS, "sheet string, sheet_pos int, row int, cells array<string>"))
    got = {r.id: r for r in rows.collect()}
    assert sorted(got) == ["CCTV 2:2", "CCTV:2", "NET:2", "RADIO:4", "RADIO:5"]
    assert (got["RADIO:4"].remarks, got["RADIO:4"].av_software, got["RADIO:5"].av_software, got["NET:2"].system) == ("a; b", "ClamWin", "Other", "FW")
    tree = {(r.system, r.location): (r.expected, r.antivirus) for r in checklist.expected_tree(rows).collect()}
    assert tree["RADIO", "HQ"] == (2, "ClamWin") and tree["FW", "Unspecified"] == (1, "Trellix")


def test_workbook_choice(spark):
    rows = [("May 2026/big log.xlsx", 9, 9), ("May 2026/May 2026 checklist.xlsx", 1, 1), ("May 2026/checklist updated.xlsx", 1, 1), ("May 2026/~$checklist.xlsx", 1, 1), ("Jun 2026/any.xlsm", 1, 1)]
    got = {r.month: r.path for r in checklist.workbook_choice(spark.createDataFrame(rows, "path string, length long, mtime long")).collect()}
    assert got == {"May 2026": "May 2026/checklist updated.xlsx", "Jun 2026": "Jun 2026/any.xlsm"}


def book(path):
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    cell = lambda ref, v, t="": f'<c r="{ref}"{t}>{v}</c>'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="RADIO" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/styles.xml", f'<styleSheet {main}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        z.writestr("xl/sharedStrings.xml", f"<sst {main}><si><t>Location</t></si><si><r><t>Sys</t></r><r><t>tem</t></r></si></sst>")
        rows = f'<row r="1">{cell("A1", "<v>0</v>", " t=\"s\"")}{cell("B1", "<v>1</v>", " t=\"s\"")}</row><row r="3">{cell("B3", "<v>7.0</v>")}{cell("C3", "<v>46146</v>", " s=\"1\"")}{cell("D3", "<is><t> x </t></is>", " t=\"inlineStr\"")}</row>'
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {main}><sheetData>{rows}</sheetData></worksheet>")


def test_workbook_source(spark, tmp_path):
    book(tmp_path / "a checklist.xlsx")
    (tmp_path / "broken.xlsx").write_bytes(b"no zip")
    spark.dataSource.register(WorkbookSource)
    got = spark.read.format("workbook").load(str(tmp_path)).orderBy("path", "row").collect()
    assert [(r.row, r.cells) for r in got if r.error is None] == [(1, ["Location", "System"]), (3, ["", "7", "2026-05-04", "x"])]
    assert [r.error for r in got if r.error] == ["The checklist workbook could not be parsed safely (BadZipFile)."]


def greedy(edges, tied):
    logs, rows, out = set(), set(), {}
    for path, row, score in sorted(edges, key=lambda e: (-e[2], e[0].lower(), e[1], e[0])):
        if path not in tied and path not in logs and row not in rows:
            out[path] = row
            logs.add(path)
            rows.add(row)
    return out


def test_assignment_is_the_greedy_one(spark):
    """Sixty random graphs in one run; they share neither logs nor rows."""
    rng = random.Random(4)
    graphs = []
    for g in range(60):
        pairs = {(f"{g}{rng.choice('abcdef')}", f"{g}:{rng.choice(['2', '10', '3', '4'])}"): rng.randint(8, 12) for _ in range(rng.randint(0, 16))}
        graphs.append([(p, r, s) for (p, r), s in pairs.items()])
    df = spark.createDataFrame([(p, r, "X", s, "t") for g in graphs for p, r, s in g], "path string, row_id string, system string, score int, target string")
    got = {r.path: r.row_id for r in matching.assigned(df).collect()}
    want = {}
    for g in graphs:
        want |= greedy(g, set())
    assert got == want and len(set(got.values())) == len(got)


def test_tied_logs_and_repeated_rows_are_all_assigned(spark):
    """1,100 logs that score alike with 1,100 rows of one target, more than a thousand rounds of single pairs; and a chain past the kept rounds."""
    n, steps = 1100, 40
    tied = spark.range(n).select(F.format_string("Log%05d", "id").alias("path")).crossJoin(spark.range(n).select(F.format_string("S:%05d", "id").alias("row_id"))).selectExpr("path", "row_id", "'X' as system", "20 as score", "'t' as target")
    got = {r.path: r.row_id for r in matching.assigned(tied).collect()}
    assert got == {f"Log{i:05d}": f"S:{i:05d}" for i in range(n)}
    edges = [(f"c{i:03d}", f"R:{j:03d}", 2000 - 2 * i - (j != i)) for i in range(steps) for j in (i, i - 1) if j >= 0]
    chain = spark.createDataFrame([(p, r, "X", s, "t") for p, r, s in edges], "path string, row_id string, system string, score int, target string")
    assert {r.path: r.row_id for r in matching.assigned(chain).collect()} == greedy(edges, set())


def test_ties_are_ambiguous(spark):
    df = spark.createDataFrame([("a", "S:2", "X", 20, "t1"), ("a", "S:10", "X", 20, "t2"), ("b", "S:2", "X", 10, "t1"), ("b", "S:10", "X", 10, "t1"), ("c", "S:10", "X", 9, "t1")], "path string, row_id string, system string, score int, target string")
    out = matching.assigned(df)
    logs = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "path string")
    got = {r.path: (r.row_id, r.ambiguous) for r in matching.match_metadata(logs, df, out).collect()}
    assert got == {"a": (None, True), "b": ("S:10", False), "c": (None, True), "d": (None, False)}


def test_mismatches(spark):
    def of(*row):
        return spark.createDataFrame([row], "a string, b string, c string, d string, e string, f string, g string").select(reconcile.mismatches(*[F.col(c) for c in "abcdefg"]).alias("m")).first().m

    assert of("Clean", "NET", "6127.005", "6127.0", "6/5/2026", "2026-05-06 10:00:00", "no") == []
    assert of("Clean", "RADIO", "55", "27000", "", "Unknown", "") == []
    assert [m.split(":")[0] for m in of("Threats Found", "NET", "6000", "6127", "1/1/2026", "2026-05-06", "no")] == ["DAT mismatch", "Scan date mismatch", "Checklist says no virus found, scanned log reports threat"]
    assert of("Clean", "NET", "6000", "Unknown", "1/1/2026", "Unknown", "yes") == ["DAT version not detected in scanned log", "Scan date not detected in scanned log", "Checklist says virus found, scanned log is clean"]
    assert of("Not Scanned", "NET", "6000", "Unknown", "1/1/2026", "Unknown", "yes") == []


def test_companions(spark):
    rows = [("1", "A", "epo_dat_report", "Manual Verification Needed"), ("2", "B", "epo_dat_report", "x"), ("3", "B", "epo_threat_report", "Clean"), ("4", "C", "epo_dat_report", "x"), ("5", "C", "epo_threat_report", "Clean"), ("6", "C", "epo_threat_report", "Manual Verification Needed"), ("7", "D", "epo_dat_report", "x"), ("8", "D", "epo_threat_report", "Clean"), ("9", "D", "epo_threat_report", "Threats Found")]
    got = {r.path: (r.companion, r.status) for r in reconcile.with_companions(spark.createDataFrame(rows, "path string, system string, role string, status string")).where("companion is not null").collect()}
    assert got == {"1": ("missing", "Manual Verification Needed"), "2": ("clean", "Clean"), "4": ("needs_review", "Manual Verification Needed"), "7": ("threats_found", "Threats Found")}


def test_manual_verdicts_need_the_same_bytes(spark):
    e = spark.createDataFrame([("a", "h1", "Threats Found", True, False), ("b", "h2", "Clean", True, False), ("c", None, "Clean", False, False), ("d", "h4", "Clean", False, True)], "path string, content_sha256 string, status string, is_outdated boolean, parse_failed boolean")
    v = spark.createDataFrame([("a", "h1", "safe"), ("b", "old", "unsafe"), ("c", None, "unsafe"), ("d", "h4", "unsafe")], "path string, content_sha256 string, verdict string")
    got = {r.path: (r.status, r.is_outdated, r.scan_status) for r in reconcile.with_manual_verdicts(e, v).collect()}
    assert got == {"a": ("Clean", False, "verified_safe"), "b": ("Clean", True, "needs_review"), "c": ("Clean", False, "healthy"), "d": ("Threats Found", False, "scan_failed")}


def test_coverage_identity(spark):
    e = [("m/p/x.png", "x.png", "PBX", "Depot", "PNG", None), ("m/RADIO/ABC 1.png", "ABC 1.png", "RADIO", "Site Radio", "PNG", None), ("m/c.pdf", "c.pdf", "CCTV", "HQ", "PDF", None), ("m/i.pdf", "i.pdf", "INFO", "Report", "PDF", ["SITE-A-PD1", "site-b"]), ("m/g.png", "[GW] occ.png", "GW", "Base System", "PNG", None), ("m/occ.png", "occ.png", "GW", "Base System", "PNG", None)]
    placed = coverage.places(spark.createDataFrame(e, "path string, display string, system string, subsystem string, type string, pdf_names array<string>"))
    n = {(r.system, r.location): r.n for r in coverage.counts(placed).collect()}
    assert n == {("PBX", "HQ East"): 1, ("PBX", "Ops Center"): 1, ("RADIO", "ABC"): 1, ("RADIO", "Site"): 1, ("CCTV", "Report"): 1, ("INFO", "SITE"): 2, ("GW", "Base System"): 1, ("GW", "Ops Center"): 1}
    expected = spark.createDataFrame([("PBX", "HQ East", 3), ("CCTV", "HQ", 3), ("RADIO", "Site", 1), ("INFO", "SITE", 0), ("NET", "x", 3)], "system string, location string, expected long")
    tree = coverage.tree_status(expected, coverage.counts(placed), coverage.unknown_systems(placed)).collect()
    assert {(r.system, r.coverage_status, r.missing, r.extra, r.unresolved_count) for r in tree} == {("PBX", "partial", 2, 0, 0), ("CCTV", "unknown", 0, 0, 3), ("RADIO", "present", 0, 0, 0), ("INFO", "present", 0, 2, 0), ("NET", "missing", 3, 0, 0)}
    assert all(r.found + r.missing + r.unresolved_count == r.expected for r in tree)


def box(x, y, w=60, h=10):
    return [[x, y], [x + w, y], [x + w, y + h], [x, y + h]]


def images(spark, **shots):
    rows = [(name, i, b, t, c, "NET", "May 2026") for name, tokens in shots.items() for i, (b, t, c) in enumerate(tokens)]
    return spark.createDataFrame([(n, i, None if b is None else [[float(v) for v in q] for q in b], t, c, s, f) for n, i, b, t, c, s, f in rows], "image string, seq int, bbox array<array<double>>, text string, confidence double, system string, folder string")


def audited(spark, strictness="high", thresholds=None, **shots):
    return {r.image: r for r in ocr.audits(images(spark, **shots), strictness, thresholds).withColumn("complete", ocr.complete()).collect()}


def test_ocr_rows_and_findings(spark):
    found = lambda tokens, least=0.9: ocr.spatial_counts(ocr.rows_of([ocr.Box.of(i, *t) for i, t in enumerate(tokens)]), least)[1:]
    assert found([(box(0, 0), "Detections:", 0.95), (box(80, 1), "3", 0.95)]) == ([("Detections:", 3)], False)
    assert found([(box(0, 0), "Detections", 0.95), (box(80, 5), "O", 0.95)]) == ([("Detections ", 0)], False)
    assert found([(box(0, 0), "Detections", 0.95), (box(300, 0), "Memory used", 0.95), (box(380, 0), "7", 0.95)]) == ([], True)
    assert found([(box(0, 0), "Detections", 0.95), (box(80, 0), "10:30", 0.95)]) == ([], True)
    assert found([(box(0, 0), "Detections", 0.95), (box(80, 0), "3", 0.5)]) == ([], True)
    assert ocr.upper_median([1, 2, 3, 4]) == 3
    got = audited(spark, a=[(box(0, 0), "Detections:", 0.95), (box(80, 1), "3", 0.95)], b=[(box(0, 0), "Detections", 0.95), (box(80, 5), "O", 0.95)], c=[(box(0, 0), "Detections", 0.95), (box(80, 0), "10:30", 0.95)])
    assert [got[k].threat_result for k in "abc"] == ["positive", "explicit_zero", "unknown"] and got["a"].status == "Threats Found"
    assert ocr.UNPLACED in got["c"].reasons


def test_ocr_audit(spark):
    good = [(box(0, 0, 100), "Scan completed", 0.95), (box(120, 0, 100), "2026-05-04 10:00:00", 0.95), (box(0, 20, 100), "DAT version", 0.95), (box(120, 20), "6127.0", 0.95), (box(0, 40), "Detections", 0.95), (box(80, 40), "0", 0.95)]
    weak = [(b, t, 0.3) for b, t, _ in good]
    thrice = [(box(0, 20 * k, 100), "Scan completed", 0.5) for k in range(3)] + [(box(120, 20 * k, 100), "2026-05-04 10:00:00", 0.2) for k in range(3)]
    flat = [(None, t, c) for _, t, c in good]
    silent = [(box(0, 0), "word", 0.9)]
    got = audited(spark, thresholds={"mcafee": 6200.0}, good=good, weak=weak, thrice=thrice, flat=flat, silent=silent)
    a = got["good"]
    assert (a.status, a.dat_version, a.last_scan, a.outdated, a.reasons, a.complete) == ("Clean", "6127.0", "2026-05-04 10:00:00", True, [], True)
    a = got["weak"]
    assert a.status == "Manual Verification Needed" and a.dat_version == "6127.0" and a.date_candidate == "2026-05-04 10:00:00" and a.last_scan == "Unknown" and not a.complete
    assert (got["thrice"].last_scan, got["thrice"].date_count) == ("2026-05-04 10:00:00", 3)
    assert got["flat"].last_scan == "2026-05-04 10:00:00" and got["silent"].status == "Manual Verification Needed"
    assert audited(spark, "low", weak=weak)["weak"].status == "Clean"


def test_ocr_reasons_and_gaps(spark):
    """Weak counts are candidates, keywords are no findings, and without places a marker's time does not reach across a gap."""
    shots = {
        "weak": [(box(0, 0), "Detections", 0.95), (box(80, 0), "4", 0.5)],
        "keyword": [(box(0, 0), "malware found in x", 0.95)],
        "gap": [(None, "Scan completed", 0.9)] + [(None, f"filler {k}", 0.2) for k in range(9)] + [(None, "2026-05-04 10:00:00", 0.9)],
        "near": [(None, "Scan completed", 0.9), (None, "2026-05-04 10:00:00", 0.9), (None, "pm", 0.1)],
    }
    got = audited(spark, **shots)
    assert got["weak"].candidate_result == "positive" and got["weak"].status == "Manual Verification Needed"
    assert "Low-confidence possible threat requires review: Detections : 4" in got["weak"].reasons
    assert [r for r in got["keyword"].reasons if r.startswith("Keyword-only")] and got["keyword"].status == "Manual Verification Needed"
    assert got["near"].last_scan == "2026-05-04 10:00:00"
    assert got["gap"].last_scan == "2026-05-04 10:00:00"  # no time is near the marker, so the first in the text stands


@pytest.mark.parametrize(
    ("text", "status"),
    [
        ("DAT version 6127.0\n\na\nb\nc\nDetections: 0\nScan completed 2026-05-04 10:00:00", "Clean"),
        ("Detections: 0\nScan completed 2026-05-04 10:00:00", "Manual Verification Needed"),
        ("Infected files\n3", "Threats Found"),
        ("malware found in x", "Threats Found"),
        ("number of threat events\nTotal 0\nTotal 1", "Manual Verification Needed"),
        ("", "Manual Verification Needed"),
    ],
)
def test_text_verdict(spark, text, status):
    files = spark.createDataFrame([("a", text, "NET", "May 2026")], "source_id string, text string, system string, folder string")
    assert T.text_verdicts(files).first().status == status


def test_last_scan_by_priority(spark):
    """Explicit wording, then the last marker of the strongest class, near times of its block, then any time of the text."""
    texts = {
        "explicit": "Scan completed 2026-05-09 10:00\nLast full scan of all (4/5/2026 9:00 AM)",
        "class": "Scan summary 2026-05-09 10:00\n1\n2\n3\n4\n5\n6\n7\nlast scan\n2026-05-02 10:00",
        "last marker": "scan completed 2026-05-01 10:00\na\nb\nc\nd\ne\nf\ng\nscan completed 2026-05-03 10:00",
        "near": "a\n2026-05-05 10:00\nscan completed\nb\n2026-05-06 11:00",
        "meridiem": "scan completed\n5/7/2026 1:07\nPM",
        "far": "2026-05-08 10:00\n1\n2\n3\n4\n5\n6\n7\nscan completed",
        "none": "2026-05-08 10:00\nwords",
        "clean words": "2026-05-08 10:00\nnothing found",
        "other month": "scan completed 2026-06-08 10:00",
    }
    files = spark.createDataFrame([(k, t, "NET", "May 2026") for k, t in texts.items()], "source_id string, text string, system string, folder string")
    got = {r.source_id: r.last_scan for r in T.text_verdicts(files).collect()}
    assert got == {"explicit": "2026-05-04 09:00", "class": "2026-05-02 10:00", "last marker": "2026-05-03 10:00", "near": "2026-05-06 11:00", "meridiem": "2026-05-07 13:07", "far": "2026-05-08 10:00", "none": "Unknown", "clean words": "2026-05-08 10:00", "other month": "Unknown"}


def test_text_findings_and_products(spark):
    texts = [
        ("a", "Files with detections: 3\nInfected files\n0\nDetections: see below", "NET"),
        ("b", "number of threat events\nTotal 4", "EPM"),
        ("c", "ClamWin\nScan Started: Mon May 0410.00.00 2026\nVirus DB Version: main 5, daily: 27001\nUpdated: 10.30 4 May 2026", "RADIO"),
        ("d", "Symantec\nDefinitions: 2024.5\nNo threats found", "NET"),
        ("e", "AMCore content version\n\n 4954.1234\nDAT version 6000.0\nDAT created on 4 May 2026", "NET"),
    ]
    files = spark.createDataFrame([(k, t, s, "May 2026") for k, t, s in texts], "source_id string, text string, system string, folder string")
    lines = files.select("source_id", "system", "folder", F.posexplode(T.lines_of(F.col("text"))).alias("n", "line"))
    got = {r.source_id: r for r in T.readings(lines, ["source_id"], wrapped=True).collect()}
    assert got["a"].threats == ["Files with detections: 3"] and got["a"].flags == [T.OPEN_LABEL.format("detections:")] and got["a"].open
    assert got["b"].threats == ["Number of Threat Events: 4"] and got["b"].last_scan == "Unknown"
    assert (got["c"].product, got["c"].dat_version, got["c"].last_scan) == ("clamwin", "27001 (Updated: 10:30 4 May 2026)", "2026-05-04 10:00:00")
    assert (got["d"].product, got["d"].dat_version, got["d"].known) == ("symantec", "2024.5", True)
    assert got["e"].dat_version == "4954.1234 (4 May 2026)"


def test_month_end_to_end(spark, tmp_path):
    month = tmp_path / "May 2026"
    for name, data in {
        "RADIO/RADIO 1.log": b"ClamWin\nScan Started Mon May 04 10:00:00 2026\nKnown viruses: 8000001\n---- SCAN SUMMARY ----\nInfected files: 0\n",
        "NET/b.csv": b"Started On,Completed,Computer,Status,Total Files,Infected,Logged By\n,2026-05-04 10:00:00,PC1,Scan Complete,10,2,job\n",
        "NET/c.txt": b"DAT version 6127.0\n\na\nb\nc\nDetections: 0\nScan completed 2026-05-04 10:00:00",
        "EPM/d.png": b"\x89PNG\r\n\x1a\nxx",
        "EPM/e.txt": b"",
        "EPM/skip.docx": b"x",
    }.items():
        (month / name).parent.mkdir(parents=True, exist_ok=True)
        (month / name).write_bytes(data)
    cells = spark.createDataFrame([("RADIO", 0, 1, ["Location", "System", "PC Name"]), ("RADIO", 0, 2, ["Base System", "RADIO 1", ""]), ("RADIO", 0, 3, ["Base System", "RADIO 2", ""])], "sheet string, sheet_pos int, row int, cells array<string>")
    out = inventory.monthly(evidence_files(spark, str(tmp_path)), cells)
    got = {r.path.split("/", 1)[1]: (r.status, r.scan_status, r.row_id) for r in out["entries"].collect()}
    assert got == {
        "RADIO/RADIO 1.log": ("Clean", "healthy", "RADIO:2"),
        "NET/b.csv": ("Threats Found", "finding_detected", None),
        "NET/c.txt": ("Clean", "healthy", None),
        "EPM/d.png": ("Not Scanned", "not_scanned", None),
        "EPM/e.txt": ("Manual Verification Needed", "scan_failed", None),
    }
    s = out["summary"].first()
    assert (s.evidence_files, s.matched_files, s.expected_evidence, s.confirmed_evidence, s.missing_evidence, s.complete) == (5, 1, 2, 1, 1, False)
    tables = report.report_tables(out["entries"], out["missing"], out["reconciliation"], spark.createDataFrame([("mcafee", 6000.0)], "engine string, value double"))
    page = report.monthly_html("May 2026", out["summary"], tables, generated=datetime.datetime(2026, 6, 1, tzinfo=datetime.UTC))
    assert "None" not in page and "<td>Threats Found</td>" in page and "Coverage incomplete" in page and "&lt;" in report.cell("<b>")


def test_state(spark, tmp_path):
    (tmp_path / "s.json").write_text('{"path": "a", "verdict": "safe"}\n{bad\n{"path": "b", "other": 1}\n')
    assert {r.path for r in state.state(spark, str(tmp_path / "s.json"), "path string, verdict string").collect()} == {"a", "b"}
    df = spark.createDataFrame([("mcafee", "6000"), ("mcafee", "-1"), ("zero_threat_confidence", "0.99"), ("zero_threat_confidence", "1"), ("ocr_strictness", "low"), ("ocr_strictness", "x"), ("mcafee", "NaN"), ("mcafee", "zz")], "e string, v string")
    assert [r.ok for r in df.select(state.valid_threshold(F.col("e"), F.col("v")).alias("ok")).collect()] == [True, False, True, False, True, False, False, False]
    rows = spark.createDataFrame([(datetime.datetime(2026, 1, 1), "e" * 200, "me", {"k": "v"})], "ts timestamp, event string, actor string, details map<string,string>")
    for _ in range(2):
        state.append_audit(rows, str(tmp_path / "audit"))
    back = state.read_audit(spark, str(tmp_path / "audit")).collect()
    assert len(back) == 2 and len(back[0].event) == 128 and back[0].details == {"k": "v"}
    first = state.replaced(df, f"file://{tmp_path}/versions")
    second = state.replaced(df.limit(1), f"file://{tmp_path}/versions")
    assert (tmp_path / "versions/CURRENT").read_text() == second != first
    old, new = (spark.createDataFrame(x, "path string, content_sha256 string") for x in ([("a", "1"), ("b", "1")], [("b", "2"), ("c", "1")]))
    assert {(r.path, r.change) for r in state.inventory_changes(old, new).collect()} == {("a", "removed"), ("b", "changed"), ("c", "added")}


def test_streaming(spark, tmp_path):
    root, out, checkpoint = tmp_path / "evidence", str(tmp_path / "out"), str(tmp_path / "cp")
    (root / "May 2026/RADIO").mkdir(parents=True)

    def go():
        q = ingest.start_inventory(ingest.new_contents(ingest.evidence_stream(spark, str(root))), out, checkpoint, str(root))
        q.awaitTermination()
        return ingest.inventory_files(spark, out).count()

    (root / "May 2026/RADIO/a.log").write_text("x")
    (root / "May 2026/RADIO/copy.log").write_text("x")
    assert go() == 1
    (root / "May 2026/RADIO/b.log").write_text("y")
    assert go() == 2 and go() == 2
