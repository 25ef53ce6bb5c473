"""Queries over plain text, screenshots, a second reader, and what a dashboard derives."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palisade.functions import scan_dates
from palisade.functions.text import is_no_count, isolated_count, lines_of
from palisade.operators import explore, ocr, scan_text, second_reader, verdicts
from palisade.plans.evidence import EVIDENCE_CTE, entries
from palisade.plans.logs import table, text
from palisade.sources import state
from palisade.sources.evidence import pdf_text, with_page_images
from palisade.streaming.ingest import sessions


def text_files(spark, sf: str) -> DataFrame:
    """A plain text report a user: a count inline, wrapped, missing, or none found; a version and a time for some."""
    u = table(spark, sf, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("n"), F.max("ts").alias("ts"))
    i = F.col("user_id")
    n = F.when(i % 5 == 0, 0).otherwise(F.col("n"))
    count = F.when(i % 4 == 0, F.concat(F.lit("Files with detections: "), text(n))).when(i % 4 == 1, F.concat(F.lit("Infected files\n"), text(n))).when(i % 4 == 2, "Files with detections:\nsee other page").otherwise("Nothing found")
    dat = F.when(i % 3 != 0, F.concat(F.lit("DAT version "), text(6000 + i % 900), F.lit(".0\n\nfirst line\nsecond line\nthird line\n"))).otherwise("")
    when = F.when(i % 7 != 0, F.concat(F.lit("Scan completed "), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))).otherwise("Scan completed")
    folder = F.when(i % 11 == 0, "Feb 2019").otherwise(F.date_format("ts", "MMM yyyy"))
    return u.select(text(i).alias("source_id"), F.concat(F.lit("Report\n"), dat, count, F.lit("\n"), when).alias("text"), F.lit("NET").alias("system"), folder.alias("folder"))


def text_verdict(spark, sf):
    out = scan_text.text_verdicts(text_files(spark, sf), thresholds={"mcafee": 6100.0})
    return out.select(F.col("source_id").cast("bigint").alias("user_id"), "status", "threat_result", "dat_version", "last_scan", "is_outdated", F.col("n_findings").cast("bigint").alias("n_findings"), F.col("n_flags").cast("bigint").alias("n_flags"))


TEXT_SQL = """WITH u AS (SELECT user_id AS i, count(*) FILTER (event_type = 'error') AS e, max(ts) AS ts FROM events GROUP BY user_id),
v AS (SELECT *, CASE WHEN i % 5 = 0 THEN 0 ELSE e END AS n, i % 4 AS kind, CASE WHEN i % 3 <> 0 THEN (6000 + i % 900) || '.0' ELSE 'Unknown' END AS dat_version, CASE WHEN i % 7 <> 0 AND i % 11 <> 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') ELSE 'Unknown' END AS last_scan FROM u),
w AS (SELECT *, CASE WHEN kind IN (0, 1) AND n > 0 THEN 'positive' WHEN kind = 2 THEN 'unknown' ELSE 'explicit_zero' END AS threat_result FROM v)
SELECT i AS user_id, CASE WHEN threat_result = 'positive' THEN 'Threats Found' WHEN threat_result = 'explicit_zero' AND dat_version <> 'Unknown' AND last_scan <> 'Unknown' THEN 'Clean' ELSE 'Manual Verification Needed' END AS status,
  threat_result, dat_version, last_scan, i % 3 <> 0 AND 6000 + i % 900 < 6100 AS is_outdated, CASE WHEN threat_result = 'positive' THEN 1 ELSE 0 END::BIGINT AS n_findings, CASE WHEN kind = 2 THEN 1 ELSE 0 END::BIGINT AS n_flags FROM w"""


def date_in_text(spark, sf):
    """The first valid time of a line, in five shapes, against a folder of its month or of another."""
    o = table(spark, sf, "orders")
    k, d = F.col("o_orderkey"), F.col("o_orderdate") + F.make_interval(hours=(F.col("o_orderkey") % 24).cast("int"), mins=(F.col("o_orderkey") % 60).cast("int"))
    line = (
        F.when(k % 5 == 0, F.date_format(d, "yyyy-MM-dd HH:mm:ss"))
        .when(k % 5 == 1, F.date_format(d, "M/d/yyyy h:mm:ss a"))
        .when(k % 5 == 2, F.date_format(d, "EEE MMM dd HH:mm:ss yyyy"))
        .when(k % 5 == 3, F.date_format(d, "d MMMM yyyy"))
        .otherwise(F.date_format(d, "d-M-yyyy HH.mm"))
    )
    folder = F.when(k % 6 == 0, "January 2031").otherwise(F.date_format(d, "MMMM yyyy"))
    return o.select("o_orderkey", scan_dates.found_datetime(F.concat(F.lit("Scan done: "), line, F.lit(" ok")), folder).alias("found"))


DATE_SQL = """WITH o AS (SELECT o_orderkey AS k, o_orderdate + to_hours(CAST(o_orderkey % 24 AS INTEGER)) + to_minutes(CAST(o_orderkey % 60 AS INTEGER)) AS d FROM orders)
SELECT k AS o_orderkey, CASE WHEN k % 6 = 0 OR year(d) < 2000 THEN '' WHEN k % 5 = 3 THEN strftime(d, '%Y-%m-%d') WHEN k % 5 = 4 THEN strftime(d, '%Y-%m-%d %H:%M') ELSE strftime(d, '%Y-%m-%d %H:%M:%S') END AS found FROM o"""


def tokens(spark, sf: str) -> DataFrame:
    """A screenshot a user: one visual row an event, of a label, a value to its right, and for some a time."""
    e = table(spark, sf, "events")
    order = F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type")))
    rows = e.groupBy("user_id").agg(order.alias("e")).select("user_id", F.posexplode("e").alias("k", "e"))
    y = F.col("k") * 20.0
    sure = F.round(0.3 + (F.col("e.event_id") % 70) / 100.0, 2)

    def box(left: float, width: float, dy: float):
        corner = lambda x, dy2: F.array(F.lit(x), y + F.lit(dy2))
        return F.array(corner(left, dy), corner(left + width, dy), corner(left + width, dy + 10.0), corner(left, dy + 10.0))

    label = F.when(F.col("e.event_type") == "error", "Detections").when(F.col("e.event_type") == "click", "Scan completed").otherwise("Files scanned")
    value = F.when(F.col("e.event_type") == "click", F.date_format(F.date_trunc("DAY", F.col("e.ts")), "yyyy-MM-dd HH:mm:ss")).otherwise(text(F.col("e.event_id") % 3))
    item = lambda seq, bbox, t: F.struct((F.col("k") * 2 + seq).cast("int").alias("seq"), bbox.alias("bbox"), t.alias("text"), sure.alias("confidence"))
    both = rows.select("user_id", F.explode(F.array(item(0, box(0.0, 80.0, 0.0), label), item(1, box(100.0, 60.0, 1.0), value))).alias("t"))
    return both.select(text(F.col("user_id")).alias("image"), "t.*")


def ocr_rows(spark, sf):
    rows = ocr.visual_rows(tokens(spark, sf))
    return rows.select(F.col("image").cast("bigint").alias("user_id"), "row_no", "text", F.col("n_items").cast("bigint").alias("n_items"))


OCR_ROWS_SQL = """SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS row_no,
  CASE event_type WHEN 'error' THEN 'Detections' WHEN 'click' THEN 'Scan completed' ELSE 'Files scanned' END || ' ' || CASE WHEN event_type = 'click' THEN strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') ELSE CAST(event_id % 3 AS VARCHAR) END AS text, CAST(2 AS BIGINT) AS n_items FROM events"""


def ocr_findings(spark, sf):
    """Three strictness profiles' verdict states of every screenshot."""
    t = tokens(spark, sf).withColumns({"system": F.lit("NET"), "folder": F.lit("Jan 2024")})
    return ocr.audits(t, ("high", "medium", "low")).select("strictness", F.col("image").cast("bigint").alias("user_id"), "status", "threat_result", "candidate_result")


OCR_POSITIVE_SQL = """WITH p AS (SELECT * FROM (VALUES ('high', 0.90), ('medium', 0.70), ('low', 0.55)) AS t(strictness, positive)),
e AS (SELECT user_id, event_id % 3 AS n, round(0.3 + (event_id % 70) / 100.0, 2) AS c FROM events WHERE event_type = 'error'),
u AS (SELECT DISTINCT user_id FROM events),
s AS (SELECT strictness, u.user_id, count(*) FILTER (c >= positive AND n > 0) AS strong, count(*) FILTER (n > 0) AS weak FROM p CROSS JOIN u LEFT JOIN e ON e.user_id = u.user_id GROUP BY ALL)
SELECT strictness, user_id, strong > 0 AS has_strong, weak > 0 AS has_weak FROM s"""


#: A label's count is open while its confidence is below the pass's; a weak last marker keeps a lenient profile from a clean verdict unless a time repeats.
OCR_FINDINGS_SQL = """WITH p AS (SELECT * FROM (VALUES ('high', 0.90, 0.50, 0.45), ('medium', 0.70, 0.50, 0.35), ('low', 0.55, 0.0, 0.0)) AS t(strictness, positive, zero, context)),
e AS (SELECT user_id, event_id, ts, event_type, event_id % 3 AS n, round(0.3 + (event_id % 70) / 100.0, 2) AS c FROM events),
k AS (SELECT strictness, any_value(context) AS context, user_id,
  count(*) FILTER (event_type = 'error' AND c >= positive AND n > 0) AS strong, count(*) FILTER (event_type = 'error' AND c >= positive) AS sure, count(*) FILTER (event_type = 'error' AND c >= zero AND n > 0) AS least, count(*) FILTER (event_type = 'error' AND c >= zero) AS read,
  count(*) FILTER (event_type = 'error' AND n > 0) AS weak, count(*) FILTER (event_type = 'error') AS labels, max(c) FILTER (event_type = 'click') AS mark, arg_max(c, {'t': ts, 'i': event_id}) FILTER (event_type = 'click') AS last_mark FROM p CROSS JOIN e GROUP BY strictness, user_id),
d AS (SELECT user_id, max(m) AS most FROM (SELECT user_id, count(*) AS m FROM e WHERE event_type = 'click' GROUP BY user_id, date_trunc('day', ts)) GROUP BY user_id),
r AS (SELECT k.*, CASE WHEN strong > 0 THEN 'positive' WHEN sure > 0 AND sure = labels THEN 'explicit_zero' ELSE 'unknown' END AS own, CASE WHEN least > 0 THEN 'positive' WHEN read > 0 AND read = labels THEN 'explicit_zero' ELSE 'unknown' END AS low,
  coalesce(last_mark < context AND NOT (most >= 3 AND mark >= context), false) AS doubt FROM k LEFT JOIN d ON d.user_id = k.user_id)
SELECT strictness, user_id, CASE WHEN strong > 0 THEN 'Threats Found' WHEN strictness = 'high' OR doubt THEN 'Manual Verification Needed' ELSE 'Clean' END AS status, CASE WHEN own <> 'positive' AND low = 'explicit_zero' THEN low ELSE own END AS threat_result,
  CASE WHEN weak > 0 THEN 'positive' WHEN labels > 0 THEN 'explicit_zero' ELSE 'unknown' END AS candidate_result FROM r"""


def ocr_positive(spark, sf):
    """Which screenshots have a trusted, and which any positive count, by strictness."""
    df = ocr_findings(spark, sf)
    return df.select("strictness", "user_id", (F.col("threat_result") == "positive").alias("has_strong"), (F.col("candidate_result") == "positive").alias("has_weak"))


def timestamp_consensus(spark, sf):
    rows = ocr.visual_rows(tokens(spark, sf))
    timed = rows.select("image", scan_dates.found_datetime(F.col("text"), F.lit("")).alias("time"))
    return ocr.timestamp_consensus(timed).select(F.col("image").cast("bigint").alias("user_id"), "agreed")


CONSENSUS_SQL = """WITH c AS (SELECT user_id, strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS t, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY 1, 2)
SELECT user_id, max(CASE WHEN n >= 3 THEN t END) AS agreed FROM c GROUP BY user_id"""


def count_tokens(spark, sf):
    e = table(spark, sf, "events")
    i = F.col("event_id")
    t = F.when(i % 6 == 0, F.concat(F.lit(": "), text(i))).when(i % 6 == 1, "O").when(i % 6 == 2, F.date_format("ts", "M/d/yyyy")).when(i % 6 == 3, F.date_format("ts", "HH:mm")).when(i % 6 == 4, F.concat(text(1000 + i), F.lit(".5"))).otherwise(F.concat(text(i), F.lit(" files")))
    return e.select("event_id", isolated_count(t).alias("n"), is_no_count(t).alias("no_count"))


COUNT_SQL = "SELECT event_id, CASE event_id % 6 WHEN 0 THEN event_id WHEN 1 THEN 0 END AS n, event_id % 6 IN (2, 3, 4) AS no_count FROM events"


def threat_state(spark, sf):
    e = table(spark, sf, "events").groupBy("user_id").agg(F.bool_or((F.col("event_type") == "error") & (F.col("event_id") % 5 == 0)).alias("p"), F.bool_or(F.col("event_type") == "click").alias("z"), F.bool_or(F.col("event_id") % 9 == 0).alias("o"))
    return e.select("user_id", verdicts.threat_state(F.col("p"), F.col("z"), F.col("o")).alias("state"))


STATE_SQL = """SELECT user_id, CASE WHEN bool_or(event_type = 'error' AND event_id % 5 = 0) THEN 'positive' WHEN bool_or(event_type = 'click') AND NOT bool_or(event_id % 9 = 0) THEN 'explicit_zero' ELSE 'unknown' END AS state FROM events GROUP BY user_id"""


def replies(spark, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    i = F.col("event_id")
    body = F.concat(F.lit('{"dat_version": "'), text(6000 + i % 300), F.lit('.0", "dat_evidence": "'), F.when(i % 3 == 0, "engine ").otherwise("DAT version "), text(6000 + i % 300), F.lit('.0", "scan_date": "'), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit('", "scan_date_evidence": "done '), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit('", "threat_count": '), text(i % 4), F.lit(', "threat_evidence": "Infected files: '), text(F.when(i % 5 == 0, 9).otherwise(i % 4)), F.lit('"}'))
    reply = F.when(i % 13 == 0, "no object here").otherwise(F.concat(F.lit("```json\n"), body, F.lit("\n``` as asked")))
    return e.select(i.alias("id"), reply.alias("reply"), F.date_format("ts", "MMM yyyy").alias("folder"), "ts")


def ai_validate(spark, sf):
    return second_reader.validated(replies(spark, sf)).select("id", "dat_version", "scan_date", F.col("threat_count").cast("bigint").alias("threat_count"), F.col("error").isNotNull().alias("failed"))


AI_SQL = """SELECT event_id AS id, CASE WHEN event_id % 13 = 0 THEN NULL WHEN event_id % 3 = 0 THEN '' ELSE (6000 + event_id % 300) || '.0' END AS dat_version, CASE WHEN event_id % 13 <> 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') END AS scan_date,
  CASE WHEN event_id % 13 <> 0 AND (event_id % 5 <> 0) THEN event_id % 4 END AS threat_count, event_id % 13 = 0 AS failed FROM events"""


def ai_reconcile(spark, sf):
    r = replies(spark, sf)
    i = F.col("id")
    first = r.select("id", F.when(i % 17 == 0, "Threats Found").otherwise("Manual Verification Needed").alias("status"), F.when(i % 7 == 0, "5000.0").otherwise("Unknown").alias("dat_version"), F.when(i % 2 == 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).otherwise("Unknown").alias("last_scan"), F.lit("unknown").alias("threat_result"), F.when(i % 6 == 0, "unknown").otherwise("explicit_zero").alias("candidate_result"), F.concat(text(6000 + i % 300), F.lit(".0")).alias("dat_candidate"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("date_candidate"), F.lit(3).alias("n_open_reasons"))
    return second_reader.reconciled(first, second_reader.validated(r)).select("id", "status", "dat_version", "last_scan", "conflict")


AI_RECONCILE_SQL = f"""WITH b AS ({AI_SQL}), f AS (SELECT event_id AS id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS t, event_id AS i FROM events),
j AS (SELECT f.*, b.dat_version AS bd, b.threat_count AS n, NOT failed AS told, i % 7 = 0 AS has_dat, i % 2 = 0 AS has_date, i % 6 <> 0 AS zero_cand FROM f JOIN b ON f.id = b.id),
k AS (SELECT *, told AND bd <> '' AND NOT has_dat AS dat_ok, told AND bd <> '' AND has_dat AS clash, told AND NOT has_date AS date_ok, coalesce(n = 0, false) AND zero_cand AS zero_ok, coalesce(n = 0, false) AND NOT zero_cand AS lone FROM j)
SELECT id, CASE WHEN i % 17 = 0 OR coalesce(n > 0, false) THEN 'Threats Found' WHEN told AND zero_ok AND (has_dat OR dat_ok) AND (has_date OR date_ok) AND NOT clash AND greatest(3 - dat_ok::INT - date_ok::INT - zero_ok::INT, 0) = 0 THEN 'Clean' ELSE 'Manual Verification Needed' END AS status,
  CASE WHEN has_dat THEN '5000.0' WHEN dat_ok THEN (6000 + i % 300) || '.0' ELSE 'Unknown' END AS dat_version, CASE WHEN has_date OR date_ok THEN t ELSE 'Unknown' END AS last_scan, clash AS conflict FROM k"""


def marked_files(spark, sf: str) -> DataFrame:
    """A text a user: a line an event, which is a marker, a time (some cut before AM or PM), a gap or filler."""
    e = table(spark, sf, "events")
    i = F.col("event_id")
    stamp = F.when(i % 3 == 0, F.concat(F.date_format("ts", "M/d/yyyy h:mm:ss"), F.lit("\n"), F.date_format("ts", "a"))).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    kind = (i + F.col("user_id")) % 11
    line = F.when(kind == 0, F.when(F.col("user_id") % 3 == 0, "Last full scan").otherwise("Scan paused")).when(kind == 1, F.when(F.col("user_id") % 2 == 0, "Scan completed").otherwise("On-demand scan")).when(kind == 2, scan_text.GAP).when(kind.between(3, 6), stamp).otherwise(F.concat(F.lit("file "), text(i % 7)))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("event_id", line.alias("line")))), lambda r: r["line"])
    return e.groupBy("user_id").agg(F.array_join(lines, "\n").alias("text")).select(text(F.col("user_id")).alias("source_id"), "text", F.lit("NET").alias("system"), F.when(F.col("user_id") % 5 == 0, "Jan 2024").otherwise("").alias("folder"))


def last_scan_priority(spark, sf):
    """When each text says the last scan was: the last line of its strongest marker, and the latest time near it within its block."""
    out = scan_text.text_verdicts(marked_files(spark, sf))
    return out.select(F.col("source_id").cast("bigint").alias("user_id"), "last_scan")


PRIORITY_SQL = """WITH e AS (SELECT user_id, event_id, ts, (event_id + user_id) % 11 AS kind, event_id % 3 = 0 AS cut FROM events),
l AS (SELECT user_id, event_id, 0 AS part, kind, ts, cut FROM e UNION ALL SELECT user_id, event_id, 1, 12, ts, cut FROM e WHERE kind BETWEEN 3 AND 6 AND cut),
n AS (SELECT *, row_number() OVER w AS n, count(*) FILTER (kind = 2) OVER w AS block FROM l WINDOW w AS (PARTITION BY user_id ORDER BY event_id, part)),
m AS (SELECT user_id, arg_max({'n': n, 'block': block}, {'s': -CASE WHEN kind = 0 AND user_id % 3 = 0 THEN 1 WHEN kind = 1 AND user_id % 2 = 0 THEN 2 ELSE 3 END, 'n': n}) AS spot FROM n WHERE kind IN (0, 1) GROUP BY user_id),
t AS (SELECT user_id, n, block, ts, CASE WHEN cut THEN make_timestamp(year(ts), month(ts), day(ts), CASE WHEN hour(ts) % 12 = 0 THEN 12 ELSE hour(ts) % 12 END, minute(ts), floor(second(ts))) ELSE date_trunc('second', ts) END AS alone, date_trunc('second', ts) AS whole, cut FROM n WHERE kind BETWEEN 3 AND 6),
u AS (SELECT *, CASE WHEN NOT cut OR user_id % 5 = 0 OR day(ts) > 12 OR day(ts) = 1 AND month(ts) = 1 THEN alone END AS read_alone, CASE WHEN NOT cut OR user_id % 5 = 0 OR day(ts) > 12 OR day(ts) = month(ts) THEN whole END AS read_whole FROM t),
near AS (SELECT m.user_id, max(coalesce(u.read_whole, u.read_alone)) AS near FROM m JOIN u ON u.user_id = m.user_id AND u.block = m.spot.block AND u.n BETWEEN m.spot.n - 6 AND m.spot.n + 6 GROUP BY m.user_id),
first AS (SELECT user_id, arg_min(read_alone, n) FILTER (read_alone IS NOT NULL) AS first FROM u GROUP BY user_id)
SELECT p.user_id, coalesce(strftime(CASE WHEN m.user_id IS NOT NULL THEN coalesce(near.near, first.first) END, '%Y-%m-%d %H:%M:%S'), 'Unknown') AS last_scan
FROM (SELECT DISTINCT user_id FROM events) p LEFT JOIN m ON m.user_id = p.user_id LEFT JOIN near ON near.user_id = p.user_id LEFT JOIN first ON first.user_id = p.user_id"""


def text_findings(spark, sf):
    """What each plain text says was found, and what about its counts is open."""
    files = text_files(spark, sf)
    lines = files.select("source_id", "system", "folder", F.posexplode(lines_of(F.col("text"))).alias("n", "line"))
    said = scan_text.readings(lines, ["source_id"], wrapped=True)
    kept = lambda column, kind: F.transform(column, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("said")))
    told = F.concat(kept("threats", "threat"), kept("flags", "open"))
    return said.select(F.col("source_id").cast("bigint").alias("user_id"), F.explode(told).alias("f")).select("user_id", "f.kind", "f.said")


FINDINGS_SQL = """WITH u AS (SELECT user_id AS i, CASE WHEN user_id % 5 = 0 THEN 0 ELSE count(*) FILTER (event_type = 'error') END AS n FROM events GROUP BY user_id)
SELECT i AS user_id, 'threat' AS kind, CASE i % 4 WHEN 0 THEN 'Files with detections: ' ELSE 'Infected files: ' END || n AS said FROM u WHERE i % 4 IN (0, 1) AND n > 0
UNION ALL SELECT i, 'open', 'A threat-count label was readable, but its value was unresolved: ''Files with detections''.' FROM u WHERE i % 4 = 2"""


def panel_tokens(spark, sf: str) -> DataFrame:
    """A screenshot a user: a heading among boxes of a line, with gaps between them that depend on the user's events, and another line below."""
    e = table(spark, sf, "events").select(F.col("user_id").alias("k"), "event_id", (F.col("event_id") % 53).cast("int").alias("gap"), (F.col("event_id") % 5).cast("int").alias("wide"), (F.col("event_id") % 9 == 0).alias("low"))
    inside = Window.partitionBy("k").orderBy("event_id")
    e = e.withColumns({"seq": F.row_number().over(inside), "left": F.sum(F.col("gap") + 30).over(inside) + F.lit(0.0), "top": F.when(F.col("low"), 115.0).otherwise(100.0)})
    right = F.col("left") + 20.0 + F.col("wide")
    words = F.when(F.col("seq") == 10, "Scan Summary").otherwise(F.concat(F.lit("w"), text(F.col("seq"))))
    return e.select(text(F.col("k")).alias("image"), "seq", F.array(F.array("left", "top"), F.array(right, F.col("top") + 10.0)).alias("bbox"), words.alias("text"), F.lit(0.9).alias("confidence"))


def panel_growth(spark, sf):
    found = ocr.panels(panel_tokens(spark, sf))
    return found.select(F.col("image").cast("bigint").alias("user_id"), "x0", "y0", "x1", "y1")


#: Boxes left and right of the heading join while a gap is at most 40 pixels and their level is the panel's.
PANEL_SQL = """WITH RECURSIVE b AS (SELECT user_id AS k, row_number() OVER w AS seq, sum(event_id % 53 + 30) OVER w AS l, event_id % 5 AS wide, event_id % 9 = 0 AS low FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
c AS (SELECT k, seq, l, l + 20 + wide AS r, low FROM b),
g AS (SELECT k, l, r, low FROM c WHERE seq = 10
  UNION SELECT g.k, least(g.l, c.l), greatest(g.r, c.r), g.low FROM g JOIN c ON c.k = g.k AND c.low = g.low AND greatest(g.l - c.r, c.l - g.r, 0) <= 40 WHERE c.l < g.l OR c.r > g.r)
SELECT k AS user_id, CAST(min(l) - 15 AS INTEGER) AS x0, CASE WHEN any_value(low) THEN 110 ELSE 95 END AS y0, CAST(max(r) + 15 AS INTEGER) AS x1, CASE WHEN any_value(low) THEN 160 ELSE 145 END AS y1 FROM g GROUP BY k"""


def page_fallback(spark, sf):
    """Text of reports whose pages hold their own text or images of several sizes, or neither."""
    d = table(spark, sf, "documents").where("doc_id is not null")
    i = F.col("doc_id")
    key = [F.concat(F.lit("report"), text(F.floor(i / 7))).alias("source_id"), (i % 7).cast("int").alias("page_no")]
    pages = d.select(*key, F.when(i % 3 == 0, F.concat(F.lit("page of document number "), text(i))).when(i % 3 == 1, " short ").alias("native_text"))
    sizes = F.explode(F.sequence(F.lit(0), (i % 4).cast("int")))
    images = d.where("doc_id % 5 <> 0").select(*key, i, sizes.alias("image_no")).select("source_id", "page_no", "image_no", (100 + (F.col("image_no") * 37 + i) % 50).alias("width"), F.lit(10).alias("height"), F.array(F.lit("seen"), F.concat(text(F.col("image_no")), F.lit(" of "), text(i))).alias("tokens"))
    out = pdf_text(with_page_images(pages, images))
    return out.select("source_id", "text", "used_ocr", F.size("warnings").cast("bigint").alias("n_warnings"))


PAGES_SQL = """WITH d AS (SELECT doc_id AS i, 'report' || (doc_id // 7) AS source_id, doc_id % 7 AS page_no FROM documents WHERE doc_id IS NOT NULL),
m AS (SELECT i, arg_max(k, (100 + (k * 37 + i) % 50) * 10 * 100 - k) AS k FROM (SELECT i, unnest(range(i % 4 + 1)) AS k FROM d WHERE i % 5 <> 0) GROUP BY i),
p AS (SELECT d.*, CASE WHEN d.i % 3 = 0 THEN 'page of document number ' || d.i WHEN m.i IS NOT NULL THEN 'seen' || chr(10) || m.k || ' of ' || d.i END AS t, d.i % 3 <> 0 AND m.i IS NOT NULL AS ocr FROM d LEFT JOIN m ON m.i = d.i)
SELECT source_id, coalesce(string_agg(t, chr(10) ORDER BY page_no), '') AS text, bool_or(ocr) AS used_ocr, count(*) FILTER (t IS NULL) AS n_warnings FROM p GROUP BY source_id"""


def audit_tail(spark, sf):
    """The newest five audit events of each actor."""
    e = table(spark, sf, "events").select("ts", F.col("event_type").alias("event"), text(F.col("user_id")).alias("actor"), F.create_map(F.lit("id"), text(F.col("event_id"))).alias("details"))
    return state.audit_tail(e, 5).select("actor", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"), "event", F.col("details")["id"].alias("id"), "k")


AUDIT_SQL = """SELECT CAST(user_id AS VARCHAR) AS actor, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, event_type AS event, CAST(event_id AS VARCHAR) AS id, CAST(k AS INTEGER) AS k
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_type, CAST(event_id AS VARCHAR)) AS k FROM events) WHERE k <= 5"""


def shown_entries(spark, sf: str) -> DataFrame:
    e = entries(spark, sf)
    i = F.col("event_id")
    return e.withColumns({
        "filename": F.col("display"),
        "dat_version": F.when(i % 3 == 0, "Unknown").otherwise(F.concat(text(6000 + i % 9), F.lit(".0"))),
        "last_scan": F.when(i % 4 == 0, "Unknown").otherwise("2024-01-05 10:00:00"),
        "dat_version_candidate": F.when(i % 6 == 0, "6111.0").otherwise(""),
        "last_scan_candidate": F.lit(""),
        "date_evidence_count": (i % 5).cast("int"),
        "verification_reasons": F.when(i % 2 == 0, F.array(F.lit("First reason"), F.concat(F.lit("Reason "), text(i % 10)))).otherwise(F.array().cast("array<string>")),
    })


def status_tallies(spark, sf):
    return explore.tallies(entries(spark, sf))


TALLY_SQL = f"""WITH {EVIDENCE_CTE}, t AS (SELECT count(*) AS total, count(*) FILTER (status = 'Clean') AS clean, count(*) FILTER (status = 'Threats Found') AS threats, count(*) FILTER (status = 'Manual Verification Needed') AS manual,
  count(*) FILTER (status = 'Not Scanned') AS not_scanned, count(*) FILTER (event_id % 13 = 0) AS outdated FROM c) SELECT *, CAST(floor((total - not_scanned) * 100.0 / total + 0.5) AS INTEGER) AS scanned_percent FROM t"""


def facet_counts(spark, sf):
    return explore.facets(entries(spark, sf), "RADIO")


FACET_SQL = f"""WITH {EVIDENCE_CTE}, r AS (SELECT ext FROM c WHERE system = 'RADIO') SELECT 'all' AS bucket, count(*) AS n FROM r UNION ALL SELECT 'images', count(*) FROM r WHERE ext = 'png' UNION ALL SELECT 'text', count(*) FROM r WHERE ext IN ('log', 'csv') UNION ALL SELECT 'pdf', count(*) FROM r WHERE ext = 'pdf'"""


def log_search(spark, sf):
    return explore.filtered(shown_entries(spark, sf), bucket="text", status="clean", search=" reason 4").select("event_id", "system", "filename")


SEARCH_SQL = f"WITH {EVIDENCE_CTE} SELECT event_id, system, display AS filename FROM c WHERE ext IN ('log', 'csv') AND status = 'Clean' AND event_id % 2 = 0 AND event_id % 10 = 4"


def action_required(spark, sf):
    return explore.action_required(shown_entries(spark, sf)).select("event_id", "action", "detail")


ACTION_SQL = f"""WITH {EVIDENCE_CTE} SELECT event_id, CASE WHEN status = 'Manual Verification Needed' THEN 'Manual verification' ELSE 'Outdated signature' END AS action,
  CASE WHEN event_id % 13 = 0 THEN CASE WHEN event_id % 3 = 0 THEN 'Unknown' ELSE (6000 + event_id % 9) || '.0' END ELSE upper(ext) END AS detail FROM c WHERE event_id % 13 = 0 OR status IN ('Manual Verification Needed', 'Threats Found')"""


def log_display(spark, sf):
    return explore.displayed(shown_entries(spark, sf)).select("event_id", "shown_dat", "shown_scan", "repeated", "shown_reason")


DISPLAY_SQL = f"""WITH {EVIDENCE_CTE} SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN (6000 + event_id % 9) || '.0' WHEN event_id % 6 = 0 THEN 'Candidate: 6111.0' ELSE '—' END AS shown_dat, CASE WHEN event_id % 4 <> 0 THEN '2024-01-05 10:00:00' ELSE '—' END AS shown_scan,
  CASE WHEN event_id % 5 >= 3 THEN 'repeated ' || (event_id % 5) END AS repeated, CASE WHEN event_id % 2 = 0 THEN 'First reason +1 more' ELSE '' END AS shown_reason FROM c"""


def threats_by_system(spark, sf):
    return explore.threats_by_system(entries(spark, sf))


THREATS_SQL = f"WITH {EVIDENCE_CTE} SELECT system, count(*) FILTER (status = 'Threats Found') AS threats FROM c GROUP BY system"


def scan_progress(spark, sf):
    e = table(spark, sf, "events")
    total = e.count()
    out = explore.progress(e.select(F.col("event_id").alias("seq"), F.concat(F.lit("f"), text(F.col("event_id"))).alias("name"), (F.col("event_type") == "error").alias("failed")), total)
    return out.select("total", "completed", "succeeded", "failed", F.array_join("failed_files", ",").alias("failed_files"), "percent", "outcome")


PROGRESS_SQL = """SELECT CAST(count(*) AS INTEGER) AS total, count(*) AS completed, count(*) FILTER (event_type <> 'error') AS succeeded, count(*) FILTER (event_type = 'error') AS failed,
  (SELECT string_agg('f' || event_id, ',' ORDER BY event_id) FROM (SELECT event_id FROM events WHERE event_type = 'error' ORDER BY event_id LIMIT 20)) AS failed_files, CAST(100 AS INTEGER) AS percent, 'completed_with_errors' AS outcome FROM events"""


def session_windows(spark, sf):
    return sessions(table(spark, sf, "events"), "6 hours").select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


SESSION_SQL = """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOURS THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, k"""

QUERIES = {
    "text_verdict": text_verdict,
    "date_in_text": date_in_text,
    "ocr_rows": ocr_rows,
    "ocr_positive": ocr_positive,
    "ocr_findings": ocr_findings,
    "timestamp_consensus": timestamp_consensus,
    "count_tokens": count_tokens,
    "threat_state": threat_state,
    "last_scan_priority": last_scan_priority,
    "text_findings": text_findings,
    "panel_growth": panel_growth,
    "page_fallback": page_fallback,
    "audit_tail": audit_tail,
    "ai_validate": ai_validate,
    "ai_reconcile": ai_reconcile,
    "status_tallies": status_tallies,
    "facet_counts": facet_counts,
    "log_search": log_search,
    "action_required": action_required,
    "log_display": log_display,
    "threats_by_system": threats_by_system,
    "scan_progress": scan_progress,
    "session_windows": session_windows,
}
ORACLES = {
    "text_verdict": TEXT_SQL,
    "date_in_text": DATE_SQL,
    "ocr_rows": OCR_ROWS_SQL,
    "ocr_positive": OCR_POSITIVE_SQL,
    "ocr_findings": OCR_FINDINGS_SQL,
    "timestamp_consensus": CONSENSUS_SQL,
    "count_tokens": COUNT_SQL,
    "threat_state": STATE_SQL,
    "last_scan_priority": PRIORITY_SQL,
    "text_findings": FINDINGS_SQL,
    "panel_growth": PANEL_SQL,
    "page_fallback": PAGES_SQL,
    "audit_tail": AUDIT_SQL,
    "ai_validate": AI_SQL,
    "ai_reconcile": AI_RECONCILE_SQL,
    "status_tallies": TALLY_SQL,
    "facet_counts": FACET_SQL,
    "log_search": SEARCH_SQL,
    "action_required": ACTION_SQL,
    "log_display": DISPLAY_SQL,
    "threats_by_system": THREATS_SQL,
    "scan_progress": PROGRESS_SQL,
    "session_windows": SESSION_SQL,
}
