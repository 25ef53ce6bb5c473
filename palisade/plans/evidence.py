"""Queries over evidence paths, the checklist, matching and coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.lineage import cut
from palisade.operators import checklist, coverage, matching, paths, reconcile, verdicts
from palisade.plans.logs import table, text
from palisade.sources.state import CACHE_ROWS, latest

FOLDERS = ["RADIO", "cctv", "EPM", "info", "Voice Report", "Depot Screenshot/NET", "Depot Screenshot/HQ Screenshot/FAC", "HQ Screenshot/HQ CCTV", "ePO Report Combined", "Site Radio old", "misc"]
SITES = ["site", "Depot", "HQ", "Room 1"]
EXTENSIONS = ["png", "log", "pdf", "csv", "docx"]
STATUSES = {"click": "Clean", "error": "Threats Found", "purchase": "Manual Verification Needed", "signup": "Not Scanned"}


def pick(values: list[str], n):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (n % len(values) + 1).cast("int"))


def sql_pick(values: list[str], n: str) -> str:
    return f"[{', '.join(repr(v) for v in values)}][({n}) % {len(values)} + 1]"


def evidence(spark, sf: str) -> DataFrame:
    """path, length, status, role, content_sha256 from events: folders by id, a site folder below some of them."""
    e = table(spark, sf, "events")
    i, u = F.col("event_id"), F.col("user_id")
    site = F.when(i % 3 != 0, F.concat(F.lit("/"), pick(SITES, u))).otherwise("")
    name = F.concat(F.when(i % 97 == 0, ".").otherwise(""), pick(["ABC radio", "as1 unit", "crs", "occ gw", "server03", "hmi2", "NATION_1 pc"], i), F.lit(" "), text(i))
    path = F.concat(F.lit("Jan 2024/"), pick(FOLDERS, i), site, F.lit("/"), name, F.lit("."), pick(EXTENSIONS, u))
    status = F.coalesce(F.create_map(*[F.lit(x) for p in STATUSES.items() for x in p])[F.col("event_type")], F.lit("Manual Verification Needed"))
    role = F.when(i % 11 == 0, "epo_dat_report").when(i % 11 == 1, "epo_threat_report").otherwise("unknown")
    return e.select(i, u, path.alias("path"), (i * 12345).alias("length"), status.alias("status"), role.alias("role"), F.sha2(text(i % 500), 256).alias("content_sha256"), "event_type")


EVIDENCE_CTE = f"""
f AS (SELECT event_id, user_id, event_type, {sql_pick(FOLDERS, "event_id")} AS folder, CASE WHEN event_id % 3 <> 0 THEN {sql_pick(SITES, "user_id")} END AS site,
  CASE WHEN event_id % 97 = 0 THEN '.' ELSE '' END || {sql_pick(["ABC radio", "as1 unit", "crs", "occ gw", "server03", "hmi2", "NATION_1 pc"], "event_id")} || ' ' || event_id AS stem, {sql_pick(EXTENSIONS, "user_id")} AS ext,
  CASE event_type WHEN 'click' THEN 'Clean' WHEN 'error' THEN 'Threats Found' WHEN 'signup' THEN 'Not Scanned' ELSE 'Manual Verification Needed' END AS status,
  CASE event_id % 11 WHEN 0 THEN 'epo_dat_report' WHEN 1 THEN 'epo_threat_report' ELSE 'unknown' END AS role, sha256(CAST(event_id % 500 AS VARCHAR)) AS content_sha256 FROM events),
p AS (SELECT *, 'Jan 2024/' || folder || coalesce('/' || site, '') || '/' || stem || '.' || ext AS path, folder || coalesce('/' || site, '') AS dir FROM f WHERE event_id % 97 <> 0 AND ext <> 'docx'),
c AS (SELECT *, '[' || dir || '] ' || stem || '.' || ext AS display,
  CASE folder WHEN 'RADIO' THEN 'RADIO' WHEN 'cctv' THEN 'CCTV' WHEN 'EPM' THEN 'EPM' WHEN 'info' THEN 'INFO' WHEN 'Voice Report' THEN 'VOICE' WHEN 'Depot Screenshot/NET' THEN 'NET'
    WHEN 'Depot Screenshot/HQ Screenshot/FAC' THEN 'FAC' WHEN 'HQ Screenshot/HQ CCTV' THEN 'CCTV' WHEN 'ePO Report Combined' THEN 'Uncategorized' WHEN 'Site Radio old' THEN 'RADIO'
    ELSE CASE WHEN stem LIKE '%radio%' THEN 'RADIO' WHEN stem LIKE '% gw%' THEN 'GW' ELSE 'Uncategorized' END END AS system,
  CASE WHEN folder IN ('RADIO', 'cctv', 'EPM', 'info') THEN CASE WHEN site IS NULL THEN 'Base System' WHEN folder = 'RADIO' AND site = 'site' THEN 'Site Radio' ELSE site END
    WHEN folder = 'Voice Report' THEN 'Site U' WHEN folder = 'Depot Screenshot/NET' THEN 'Depot' WHEN folder IN ('Depot Screenshot/HQ Screenshot/FAC', 'HQ Screenshot/HQ CCTV') THEN 'HQ'
    WHEN folder = 'ePO Report Combined' THEN 'Report' WHEN folder = 'Site Radio old' THEN 'Site Radio' WHEN stem LIKE '%radio%' OR stem LIKE '% gw%' THEN 'Unspecified' ELSE 'Base System' END AS subsystem FROM p)"""


def path_classification(spark, sf):
    return paths.inventory(evidence(spark, sf)).select("path", "month", "system", "subsystem", "display", "kind")


PATH_SQL = f"WITH {EVIDENCE_CTE} SELECT path, 'Jan 2024' AS month, system, subsystem, display, CASE ext WHEN 'png' THEN 'image' WHEN 'pdf' THEN 'pdf' ELSE 'text' END AS kind FROM c"


def evidence_inventory(spark, sf):
    return paths.inventory(evidence(spark, sf)).groupBy("kind", "system").agg(F.count("*").alias("n"), F.count_if("too_large").alias("n_too_large"), F.min(F.lower("path")).alias("first_path"))


INVENTORY_SQL = f"""WITH {EVIDENCE_CTE}, k AS (SELECT *, CASE ext WHEN 'png' THEN 'image' WHEN 'pdf' THEN 'pdf' ELSE 'text' END AS kind FROM c)
SELECT kind, system, count(*) AS n, count(*) FILTER (event_id * 12345 > CASE kind WHEN 'image' THEN 52428800 WHEN 'pdf' THEN 104857600 ELSE 10485760 END) AS n_too_large, min(lower(path)) AS first_path FROM k GROUP BY kind, system"""


def month_list(spark, sf):
    o = table(spark, sf, "orders").select(F.concat(F.date_format("o_orderdate", "MMM yyyy"), F.lit("/x.log")).alias("path"))
    return paths.months(o).select("month", "year", F.col("month_no").cast("int").alias("month_no"))


MONTHS_SQL = "SELECT DISTINCT strftime(o_orderdate, '%b %Y') AS month, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month_no FROM orders"


def content_dedup(spark, sf):
    """One inference for each distinct content, joined back to every file that has it."""
    d = table(spark, sf, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_sha256"), F.length("text").alias("n"))
    once = d.groupBy("content_sha256").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"))
    return d.join(once, "content_sha256").select("doc_id", "content_sha256", "first_id", "copies")


DEDUP_SQL = "SELECT doc_id, sha256(coalesce(text, '')) AS content_sha256, min(doc_id) OVER w AS first_id, count(*) OVER w AS copies FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))"

SHEETS = ["RADIO", "CCTV", "EPM", "NET", "FAC", "SUPERVISORY 1", "INFO"]


def cells(spark, sf: str) -> DataFrame:
    """Workbook cells from customers: one sheet for each of seven systems, header on row 3, and a copy of the first sheet under another name."""
    c = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    k = F.col("c_custkey")
    item = F.concat(pick(["RADIO", "CCTV", "EPM", "FW", "FAC", "GW", "INFO"], k), F.lit(" "), text(k % 50))
    av = F.when(k % 5 == 0, "").when(k % 5 == 1, "clam av").when(k % 5 == 2, "ePO 5").when(k % 5 == 3, "Trellix ENS").otherwise("Other")
    row = F.array(F.when(k % 29 == 0, "").otherwise(F.col("n_name")), item, F.col("c_name"), text(6000 + k % 300), F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (k % 28).cast("int")), "d/M/yyyy"), F.when(k % 2 == 0, "no").otherwise("yes"), av, F.when(k % 3 == 0, "seen").otherwise(""), F.when(k % 4 == 0, "checked").otherwise(""))
    rows = c.select(pick(SHEETS, k).alias("sheet"), (k % 7).cast("int").alias("sheet_pos"), (k + 4).cast("int").alias("row"), row.alias("cells"))
    again = rows.where("sheet = 'RADIO'").select(F.lit("RADIO 2").alias("sheet"), F.lit(9).alias("sheet_pos"), "row", "cells")
    head = F.array(*[F.lit(h) for h in ("Location", "System", "Host Name", "DAT Version", "Date Scanned", "Virus Found", "AV Software", "Remarks", "Remarks 2")])
    names = rows.unionByName(again).select("sheet", "sheet_pos").distinct().withColumns({"row": F.lit(3), "cells": head})
    return rows.unionByName(again).unionByName(names).unionByName(spark.createDataFrame([("Global Checklist", 8, 3, ["Location", "System"]), ("Global Checklist", 8, 4, ["x", "y"])], "sheet string, sheet_pos int, row int, cells array<string>"))


CHECKLIST_CTE = f"""
k AS (SELECT c_custkey AS k, c_name, CASE WHEN c_custkey % 29 = 0 THEN '' ELSE n_name END AS location, {sql_pick(SHEETS, "c_custkey")} AS sheet, {sql_pick(["RADIO", "CCTV", "EPM", "FW", "FAC", "GW", "INFO"], "c_custkey")} || ' ' || (c_custkey % 50) AS item
  FROM customer JOIN nation ON c_nationkey = n_nationkey),
rows AS (SELECT sheet || ':' || (k + 4) AS id, k, {sql_pick(["RADIO", "CCTV", "EPM", "FW", "FAC", "GW", "INFO"], "k")} AS system, location, item, c_name AS pc_name, sheet, CAST(6000 + k % 300 AS VARCHAR) AS dat_version,
  strftime(DATE '2024-01-01' + CAST(k % 28 AS INTEGER), '%-d/%-m/%Y') AS date_scan, CASE WHEN k % 2 = 0 THEN 'no' ELSE 'yes' END AS virus_found,
  concat_ws('; ', CASE WHEN k % 3 = 0 THEN 'seen' END, CASE WHEN k % 4 = 0 THEN 'checked' END) AS remarks FROM k),
av AS (SELECT *, CASE k % 5 WHEN 0 THEN CASE WHEN system = 'RADIO' THEN 'ClamWin' WHEN system IN ('CCTV', 'EPM', 'INFO') THEN 'McAfee' WHEN system IN ('FW', 'FAC') THEN 'Trellix' ELSE 'Unknown' END
   WHEN 1 THEN 'ClamWin' WHEN 2 THEN 'McAfee' WHEN 3 THEN 'Trellix' ELSE 'Other' END AS av_software FROM rows)"""


def checklist_rows(spark, sf):
    return checklist.checklist_rows(cells(spark, sf)).select("id", "system", "location", "item", "pc_name", "dat_version", "date_scan", "virus_found", "av_software", "remarks")


ROWS_SQL = f"WITH {CHECKLIST_CTE} SELECT id, system, location, item, pc_name, dat_version, date_scan, virus_found, av_software, remarks FROM av"


def checklist_tree(spark, sf):
    return checklist.expected_tree(checklist.checklist_rows(cells(spark, sf))).select("system", "location", "expected", "antivirus")


TREE_CTE = f"""{CHECKLIST_CTE}, n AS (SELECT system, CASE WHEN location = '' THEN 'Unspecified' ELSE location END AS location, av_software, count(*) AS n, min(k) AS first FROM av GROUP BY 1, 2, 3),
tree AS (SELECT system, location, CAST(sum(n) AS BIGINT) AS expected, arg_max(av_software, (n, -first)) AS antivirus FROM n GROUP BY system, location)"""
TREE_SQL = f"WITH {TREE_CTE} SELECT * FROM tree"


def sheet_dedup(spark, sf):
    return checklist.checklist_rows(cells(spark, sf)).groupBy("sheet").agg(F.count("*").alias("n"))


SHEET_SQL = f"WITH {CHECKLIST_CTE} SELECT sheet, count(*) AS n FROM rows GROUP BY sheet"


def matchable(spark, sf: str) -> tuple[DataFrame, DataFrame]:
    """Logs and checklist rows. Paths are written first: else each place that reads one would make it again, in the few tasks of a small table."""
    return paths.inventory(cut(evidence(spark, sf).select("path").repartition("path"))), checklist.checklist_rows(cells(spark, sf))


def found_best(spark, sf: str) -> tuple[DataFrame, matching.Matches, DataFrame]:
    """Logs, their matches, and the best of each."""
    logs, rows = matchable(spark, sf)
    found = matching.matches(logs, rows)
    return logs, found, cut(matching.best_of(found))


def match_edges(spark, sf):
    return matching.match_edges(*matchable(spark, sf)).select("path", "row_id", "system", F.col("score").cast("bigint").alias("score"))


def _compact(x: str) -> str:
    return f"regexp_replace(lower({x}), '[^a-z0-9]', '', 'g')"


def _words(x: str) -> str:
    stop = ", ".join(f"'{w}'" for w in "pc client server system radio trellix mcafee clamwin nms user scan done yes no the and for rom".split())
    return f"list_filter(regexp_extract_all(lower({x}), '[a-z0-9]+'), lambda w: len(w) >= 2 AND w NOT IN ({stop}))"


def _equipment(x: str) -> str:
    lead = "radio|cctv|epm|info|net|pbx|audio|voice|fac|nvr|fw|gw|supervisory"
    return f"replace(regexp_replace(array_to_string(regexp_extract_all(lower({x}), '[a-z]+|[0-9]+'), ' '), '^(?:(?:{lead})(?: |$))+', ''), ' ', '')"


def _tokens(*values: str) -> str:
    return f"list_distinct(list_concat(list_filter([{', '.join(_compact(v) for v in values)}], lambda v: len(v) >= 3), {', '.join(_words(v) for v in values)}))"


def _value_score(v: str) -> str:
    key, dev = f"{v}_key", f"{v}_dev"
    return f"""CASE WHEN {dev} <> '' AND {dev} = name_key THEN 48 WHEN {dev} <> '' AND contains(name_key, {dev}) THEN 36
      WHEN regexp_matches({dev}, '^[a-z]+[0-9]+$') AND contains(name_key, regexp_extract({dev}, '^([a-z]+)', 1)) AND suffix(name_key, regexp_extract({dev}, '([0-9]+)$', 1)) THEN 24 ELSE 0 END
    + CASE WHEN {key} <> '' AND {key} = name_key THEN 60 WHEN {key} <> '' AND contains(look, {key}) THEN 24 WHEN {key} <> '' AND look <> '' AND contains({key}, look) THEN 8 ELSE 0 END
    + CASE WHEN prefix({key}, sys_key) AND len({key}) > len(sys_key) AND contains(look, {key}[len(sys_key) + 1:]) THEN 18 ELSE 0 END"""


EDGES_CTE = f"""{EVIDENCE_CTE}, {CHECKLIST_CTE},
h AS (SELECT *, CASE WHEN system <> 'RADIO' THEN subsystem WHEN {_compact("subsystem")} = 'siteradio' THEN CASE WHEN regexp_matches(stem, '^\\s*[A-Za-z]{{3}}\\b') THEN upper(regexp_extract(stem, '^\\s*([A-Za-z]{{3}})\\b', 1)) ELSE subsystem END
  WHEN {_compact("subsystem")} = 'depot' THEN CASE WHEN regexp_matches(stem, '(?i)\\bas\\s*[-_]?\\s*[12]\\b') THEN 'Operations Center' WHEN regexp_matches({_compact("stem")}, 'crs|gw|nms') THEN 'HQ East' ELSE subsystem END ELSE subsystem END AS hint FROM c),
lg AS (SELECT path, system, {_compact("stem")} AS name_key, {_compact("hint")} AS hint_key, {_compact("system || ' ' || hint || ' ' || stem || ' ' || display")} AS look, {_tokens("system", "subsystem", "stem", "display")} AS toks, lower(system) AS sys_key FROM h),
rw AS (SELECT id, system, {_compact("location")} AS loc_key, {_compact("item")} AS item_key, {_compact("pc_name")} AS pc_key, {_equipment("item")} AS item_dev, {_equipment("pc_name")} AS pc_dev,
  {_tokens("system", "location", "item", "pc_name", "sheet")} AS rtoks FROM rows),
e AS (SELECT path, id AS row_id, lg.system, loc_key || '|' || item_key || '|' || pc_key AS target, CAST(CASE WHEN loc_key <> '' AND loc_key = hint_key THEN 16 WHEN loc_key <> '' AND contains(look, loc_key) THEN 10 ELSE 0 END
  + {_value_score("item")} + {_value_score("pc")} + 3 * least(len(list_intersect(toks, rtoks)), 6) AS BIGINT) AS score FROM lg JOIN rw ON lg.system = rw.system),
edges AS (SELECT * FROM e WHERE score >= 8)"""
EDGES_SQL = f"WITH {EDGES_CTE} SELECT path, row_id, system, score FROM edges"


def match_ambiguous(spark, sf):
    return matching.best_of(matching.matches(*matchable(spark, sf))).where("tied").select("path", F.col("score").cast("bigint").alias("score"))


AMBIGUOUS_CTE = f"{EDGES_CTE}, tie AS (SELECT path, score FROM (SELECT *, max(score) OVER (PARTITION BY path) AS best FROM edges) WHERE score = best GROUP BY path, score HAVING count(DISTINCT target) > 1)"
AMBIGUOUS_SQL = f"WITH {AMBIGUOUS_CTE} SELECT path, score FROM tie"


def best_row(spark, sf):
    return matching.best_of(matching.matches(*matchable(spark, sf))).select("path", "row_id", F.col("score").cast("bigint").alias("score"))


BEST_SQL = f"WITH {EDGES_CTE} SELECT path, row_id, score FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY score DESC, row_id) AS k FROM edges) WHERE k = 1"


def match_assigned(spark, sf):
    _, found, best = found_best(spark, sf)
    return matching.assigned_of(found, best).select("path", "row_id", F.col("score").cast("bigint").alias("score"))


#: The greedy pass itself: a system's edges in order, each kept unless its log or its row is taken.
ASSIGNED_CTE = f"""{AMBIGUOUS_CTE}, item AS (SELECT system, {{'p': [path], 'r': [row_id], 's': [score]}} AS x, score, path, row_id FROM edges ANTI JOIN tie ON tie.path = edges.path),
z AS (SELECT list_reduce(list(x ORDER BY score DESC, lower(path), row_id, path), lambda acc, one: CASE WHEN list_has_any(acc.p, one.p) OR list_has_any(acc.r, one.r) THEN acc ELSE {{'p': list_concat(acc.p, one.p), 'r': list_concat(acc.r, one.r), 's': list_concat(acc.s, one.s)}} END) AS z FROM item GROUP BY system),
asg AS (SELECT unnest(z.p) AS path, unnest(z.r) AS row_id, unnest(z.s) AS score FROM z)"""
ASSIGNED_SQL = f"WITH {ASSIGNED_CTE} SELECT path, row_id, score FROM asg"
OUTCOMES_SQL = f"""WITH {ASSIGNED_CTE}, m AS (SELECT c.path, asg.path IS NOT NULL AS matched, tie.path IS NOT NULL AS tied, e.path IS NOT NULL AS known FROM c LEFT JOIN asg ON asg.path = c.path LEFT JOIN tie ON tie.path = c.path LEFT JOIN (SELECT DISTINCT path FROM edges) e ON e.path = c.path)
SELECT tied OR known AND NOT matched AS ambiguous, CASE WHEN matched THEN '' WHEN tied THEN 'Multiple checklist rows matched with the same confidence.' WHEN known THEN 'The best checklist row was already assigned to other evidence.' ELSE 'No checklist row matched.' END AS reason, count(*) AS n FROM m GROUP BY ALL"""


def match_outcomes(spark, sf):
    logs, found, best = found_best(spark, sf)
    return matching.outcomes(logs, best, matching.assigned_of(found, best)).groupBy("ambiguous", "reason").agg(F.count("*").alias("n"))


def entries(spark, sf: str) -> DataFrame:
    """Inventory with a verdict each: what coverage and the report start from."""
    e = paths.inventory(evidence(spark, sf))
    failed = F.col("event_id") % 41 == 0
    names = F.when((F.col("system") == "INFO") & (F.col("event_id") % 2 == 0), F.array(F.lit("SITE1-PD1"), F.lit("site2-x"), F.lit("")))
    return e.withColumns({"parse_failed": failed, "is_outdated": F.col("event_id") % 13 == 0, "pdf_names": names, "row_id": F.when(F.col("event_id") % 4 != 0, text(F.col("event_id"))), "match_ambiguous": F.col("event_id") % 8 == 0, "match_reason": F.lit("No checklist row matched.")}).withColumn("scan_status", verdicts.scan_status(F.col("status"), F.col("is_outdated"), failed, F.lit(None).cast("string")))


STATUS = "CASE WHEN event_id % 41 = 0 THEN 'scan_failed' WHEN status = 'Not Scanned' THEN 'not_scanned' WHEN status = 'Threats Found' THEN 'finding_detected' WHEN status = 'Manual Verification Needed' OR event_id % 13 = 0 THEN 'needs_review' ELSE 'healthy' END"


def companion_reconcile(spark, sf):
    return reconcile.with_companions(paths.inventory(evidence(spark, sf))).where("role = 'epo_dat_report'").select("path", "system", "companion", "status", F.size("companion_paths").cast("bigint").alias("n_companions"))


COMPANION_SQL = f"""WITH {EVIDENCE_CTE}, t AS (SELECT system, bool_or(status = 'Threats Found') AS bad, bool_and(status = 'Clean') AS clean, count(*) AS n FROM c WHERE role = 'epo_threat_report' GROUP BY system)
SELECT path, c.system, CASE WHEN n IS NULL THEN 'missing' WHEN bad THEN 'threats_found' WHEN clean THEN 'clean' ELSE 'needs_review' END AS companion,
  CASE WHEN bad THEN 'Threats Found' WHEN clean THEN 'Clean' ELSE 'Manual Verification Needed' END AS status, coalesce(n, 0) AS n_companions FROM c LEFT JOIN t ON c.system = t.system WHERE role = 'epo_dat_report'"""


def coverage_parts(spark, sf):
    placed = coverage.places(entries(spark, sf))
    expected = checklist.expected_tree(checklist.checklist_rows(cells(spark, sf))).select("system", "location", "expected")
    extra = spark.sql("SELECT * FROM VALUES ('RADIO', 'Site', 5000L), ('RADIO', 'ABC', 1L), ('CCTV', 'Report', 3L), ('INFO', 'SITE1', 2L), ('VOICE', 'Site U', 100000L), ('PBX', 'HQ East', 0L) AS t(system, location, expected)")
    expected = expected.unionByName(extra)
    return placed, coverage.tree_status(expected, coverage.counts(placed), coverage.unknown_systems(placed))


def coverage_counts(spark, sf):
    return coverage.counts(coverage.places(entries(spark, sf)))


COUNTS_CTE = f"""{EVIDENCE_CTE}, inc AS (
SELECT *, CASE
  WHEN ext = 'pdf' AND system = 'EPM' THEN ['Report']
  WHEN ext = 'pdf' AND system = 'INFO' THEN CASE WHEN event_id % 2 = 0 THEN ['SITE1', 'SITE2'] ELSE [] END
  WHEN ext = 'pdf' AND system = 'CCTV' THEN ['Report']
  WHEN system = 'RADIO' AND subsystem = 'Site Radio' THEN CASE WHEN stem LIKE 'ABC %' THEN ['ABC', 'Site'] WHEN stem LIKE 'as1 %' THEN ['AS1', 'Site'][2:] WHEN stem LIKE 'crs %' THEN ['CRS', 'Site'] WHEN stem LIKE 'occ %' THEN ['OCC', 'Site'] ELSE ['Site'] END
  WHEN system = 'RADIO' AND subsystem = 'Depot' THEN CASE WHEN regexp_matches(lower(display), 'as1|as2') THEN ['Depot', 'Operations Center'] WHEN regexp_matches(lower(display), 'crs|gw|nms') THEN ['Depot', 'HQ East'] ELSE ['Depot'] END
  WHEN system = 'NET' AND subsystem = 'Depot' THEN CASE WHEN contains(display, '03') THEN ['Data Center'] ELSE ['HQ East'] END
  WHEN system = 'VOICE' THEN ['Site U']
  WHEN system = 'FAC' AND subsystem IN ('Base System', 'Depot') THEN ['HQ East']
  ELSE [subsystem] END AS places FROM c),
cnt AS (SELECT system, location, count(*) AS n FROM (SELECT system, unnest(places) AS location FROM inc) GROUP BY system, location)"""
COUNTS_SQL = f"WITH {COUNTS_CTE} SELECT * FROM cnt"


def coverage_tree(spark, sf):
    return coverage_parts(spark, sf)[1].select("system", "location", "expected", "found", "missing", "extra", "coverage_status", "unresolved_count")


STATUS_CTE = f"""{COUNTS_CTE}, {TREE_CTE.lstrip()},
ex AS (SELECT system, location, expected FROM tree UNION ALL SELECT * FROM (VALUES ('RADIO', 'Site', 5000), ('RADIO', 'ABC', 1), ('CCTV', 'Report', 3), ('INFO', 'SITE1', 2), ('VOICE', 'Site U', 100000), ('PBX', 'HQ East', 0))),
unk AS (SELECT DISTINCT system FROM inc WHERE ext = 'pdf' AND (system IN ('EPM', 'CCTV') OR (system = 'INFO' AND event_id % 2 <> 0))),
j AS (SELECT ex.system, ex.location, CAST(expected AS BIGINT) AS expected, coalesce(n, 0) AS raw, least(coalesce(n, 0), expected) AS found, unk.system IS NOT NULL AS u FROM ex LEFT JOIN cnt USING (system, location) LEFT JOIN unk ON ex.system = unk.system),
st AS (SELECT *, CASE WHEN found >= expected THEN 'present' WHEN u THEN 'unknown' WHEN found > 0 THEN 'partial' ELSE 'missing' END AS coverage_status FROM j),
tr AS (SELECT system, location, expected, CAST(found AS BIGINT) AS found, CAST(CASE WHEN coverage_status IN ('partial', 'missing') THEN expected - found ELSE 0 END AS BIGINT) AS missing, CAST(greatest(raw - expected, 0) AS BIGINT) AS extra, coverage_status,
  CAST(CASE WHEN coverage_status = 'unknown' THEN expected - found ELSE 0 END AS BIGINT) AS unresolved_count FROM st)"""
COVERAGE_SQL = f"WITH {STATUS_CTE} SELECT * FROM tr"


def missing_alerts(spark, sf):
    return coverage.missing_alerts(coverage_parts(spark, sf)[1])


MISSING_SQL = f"WITH {STATUS_CTE} SELECT system, location AS subsystem, expected, found, missing FROM tr WHERE coverage_status IN ('missing', 'partial') AND missing > 0"


def missing_rollup(spark, sf):
    return coverage.missing_rollup(missing_alerts(spark, sf)).select("system", "places", "expected", "found", "missing", F.col("is_total").cast("int").alias("is_total"))


ROLLUP_SQL = f"""WITH {STATUS_CTE}, a AS (SELECT * FROM tr WHERE coverage_status IN ('missing', 'partial') AND missing > 0)
SELECT coalesce(system, 'TOTAL') AS system, count(*) AS places, CAST(sum(expected) AS BIGINT) AS expected, CAST(sum(found) AS BIGINT) AS found, CAST(sum(missing) AS BIGINT) AS missing, CAST(grouping(system) AS INTEGER) AS is_total FROM a GROUP BY ROLLUP (system)"""


def reconciliation_union(spark, sf):
    placed, tree = coverage_parts(spark, sf)
    return coverage.reconciliation(placed, tree).groupBy("type", "system").agg(F.count("*").alias("n"), F.sum("unresolved").alias("unresolved"))


RECONCILE_SQL = f"""WITH {STATUS_CTE} SELECT 'unmapped_evidence' AS type, system, count(*) AS n, CAST(NULL AS BIGINT) AS unresolved FROM inc WHERE event_id % 4 = 0 GROUP BY system
UNION ALL SELECT 'unknown_coverage', system, count(*), CAST(sum(unresolved_count) AS BIGINT) FROM tr WHERE coverage_status = 'unknown' GROUP BY system"""


def coverage_summary(spark, sf):
    placed, tree = coverage_parts(spark, sf)
    return coverage.summary(tree, placed)


SUMMARY_SQL = f"""WITH {STATUS_CTE}, s AS (SELECT *, {STATUS} AS ss FROM inc),
a AS (SELECT CAST(sum(expected) AS BIGINT) AS expected_evidence, CAST(sum(found) AS BIGINT) AS confirmed_evidence, CAST(sum(missing) AS BIGINT) AS missing_evidence, CAST(sum(unresolved_count) AS BIGINT) AS unknown_coverage FROM tr),
b AS (SELECT count(*) AS evidence_files, count(*) FILTER (event_id % 4 <> 0) AS matched_files, count(*) FILTER (event_id % 4 = 0) AS unmatched_files, count(*) FILTER (event_id % 8 = 0) AS ambiguous_files, count(*) FILTER (ss = 'not_scanned') AS not_scanned_files,
  count(*) FILTER (ss = 'scan_failed') AS failed_files, count(*) FILTER (ss = 'needs_review') AS review_files, count(*) FILTER (ss = 'finding_detected') AS finding_files FROM s)
SELECT *, missing_evidence + unknown_coverage + failed_files + not_scanned_files + ambiguous_files = 0 AS complete FROM a, b"""


def checklist_validation(spark, sf):
    c = table(spark, sf, "customer")
    k = F.col("c_custkey")
    status = pick(["Clean", "Threats Found", "Not Scanned", "Manual Verification Needed"], k)
    log_dat = F.when(k % 6 == 0, "Unknown").otherwise(F.concat(text(6000 + (k + k % 2) % 300), F.lit(".005")))
    log_date = F.when(k % 10 == 0, "Unknown").otherwise(F.concat(F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), ((k + k % 3) % 28).cast("int")), "yyyy-MM-dd"), F.lit(" 10:00:00")))
    chk_date = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (k % 28).cast("int")), "d/M/yyyy")
    found = reconcile.mismatches(status, F.when(k % 7 == 0, "RADIO").otherwise("NET"), F.when(k % 9 == 0, "55").otherwise(text(6000 + k % 300)), log_dat, chk_date, log_date, F.when(k % 2 == 0, "No ").otherwise("yes"))
    return c.select("c_custkey", F.size(found).cast("bigint").alias("n"), F.array_join(found, "|").alias("mismatches"))


VALIDATION_SQL = """WITH v AS (SELECT c_custkey AS k, ['Clean', 'Threats Found', 'Not Scanned', 'Manual Verification Needed'][c_custkey % 4 + 1] AS status, CASE WHEN c_custkey % 7 = 0 THEN 'RADIO' ELSE 'NET' END AS system,
  CASE WHEN c_custkey % 9 = 0 THEN '55' ELSE CAST(6000 + c_custkey % 300 AS VARCHAR) END AS cd, CASE WHEN c_custkey % 6 = 0 THEN 'Unknown' ELSE (6000 + (c_custkey + c_custkey % 2) % 300) || '.005' END AS ld,
  DATE '2024-01-01' + CAST(c_custkey % 28 AS INTEGER) AS d1, DATE '2024-01-01' + CAST((c_custkey + c_custkey % 3) % 28 AS INTEGER) AS d2 FROM customer),
m AS (SELECT k, CASE WHEN status <> 'Not Scanned' AND ld = 'Unknown' THEN 'DAT version not detected in scanned log'
  WHEN status <> 'Not Scanned' AND NOT (system = 'RADIO' AND CAST(cd AS DOUBLE) < 1000) AND abs(CAST(cd AS DOUBLE) - TRY_CAST(ld AS DOUBLE)) >= 0.01 THEN 'DAT mismatch: checklist ' || cd || ', scanned ' || ld END AS a,
  CASE WHEN status = 'Not Scanned' THEN NULL WHEN k % 10 = 0 THEN 'Scan date not detected in scanned log'
  WHEN NOT (d1 = d2 OR coalesce(CASE WHEN day(d1) <= 12 THEN make_date(2024, day(d1), month(d1)) END = d2, false)) THEN 'Scan date mismatch: checklist ' || strftime(d1, '%-d/%-m/%Y') || ', scanned ' || strftime(d2, '%Y-%m-%d') || ' 10:00:00' END AS b,
  CASE WHEN k % 2 = 0 AND status = 'Threats Found' THEN 'Checklist says no virus found, scanned log reports threat' WHEN k % 2 = 1 AND status = 'Clean' THEN 'Checklist says virus found, scanned log is clean' END AS c FROM v)
SELECT k AS c_custkey, CAST((a IS NOT NULL)::INT + (b IS NOT NULL)::INT + (c IS NOT NULL)::INT AS BIGINT) AS n, concat_ws('|', a, b, c) AS mismatches FROM m"""


def verdict_log(spark, sf: str) -> DataFrame:
    """People's verdicts on documents: some hashes are of other bytes, some are missing."""
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    sha = F.when(F.col("doc_id") % 7 == 0, F.lit(None)).otherwise(F.sha2(F.concat(F.coalesce("text", F.lit("")), F.when(F.col("doc_id") % 5 == 0, "x").otherwise("")), 256))
    verdict = F.when(F.col("toxic") == 1, "unsafe").when(F.col("quality") == 1, "safe").otherwise("clear")
    return d.select(F.concat(F.lit("doc/"), text(F.col("doc_id"))).alias("path"), sha.alias("content_sha256"), verdict.alias("verdict"), F.col("doc_id").alias("at"))


def manual_override(spark, sf):
    d = table(spark, sf, "documents")
    i = F.col("doc_id")
    base = d.select("doc_id", F.concat(F.lit("doc/"), text(i)).alias("path"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_sha256"), pick(["Clean", "Threats Found", "Not Scanned", "Manual Verification Needed"], i).alias("status"), (i % 3 == 0).alias("is_outdated"), (i % 17 == 0).alias("parse_failed"))
    return reconcile.with_manual_verdicts(base, verdict_log(spark, sf).where("verdict <> 'clear'")).select("doc_id", "status", "is_outdated", "scan_status", "verification")


OVERRIDE_SQL = """WITH v AS (SELECT doc_id, CASE WHEN doc_id % 7 <> 0 AND doc_id % 5 <> 0 THEN CASE WHEN toxic = 1 THEN 'unsafe' WHEN quality = 1 THEN 'safe' END END AS verification FROM labels),
b AS (SELECT d.doc_id, ['Clean', 'Threats Found', 'Not Scanned', 'Manual Verification Needed'][d.doc_id % 4 + 1] AS s0, d.doc_id % 3 = 0 AS o0, verification FROM documents d LEFT JOIN v ON d.doc_id = v.doc_id),
c AS (SELECT *, CASE verification WHEN 'safe' THEN 'Clean' WHEN 'unsafe' THEN 'Threats Found' ELSE s0 END AS status, o0 AND verification IS NULL AS is_outdated FROM b)
SELECT doc_id, status, is_outdated, CASE WHEN doc_id % 17 = 0 THEN 'scan_failed' WHEN status = 'Not Scanned' THEN 'not_scanned' WHEN status = 'Threats Found' THEN 'finding_detected' WHEN status = 'Manual Verification Needed' OR is_outdated THEN 'needs_review'
  WHEN verification = 'safe' THEN 'verified_safe' ELSE 'healthy' END AS scan_status, verification FROM c"""


def verdict_upsert(spark, sf):
    """Latest verdict a user gave, from a log in which a signup clears."""
    e = table(spark, sf, "events").select("user_id", "ts", "event_id", F.when(F.col("event_type") == "signup", "clear").when(F.col("event_type") == "error", "unsafe").otherwise("safe").alias("verdict"))
    return latest(e, "user_id", "ts", F.col("verdict") == "clear").select("user_id", "verdict", "event_id")


UPSERT_SQL = "SELECT user_id, CASE WHEN event_type = 'error' THEN 'unsafe' ELSE 'safe' END AS verdict, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS k FROM events) WHERE k = 1 AND event_type <> 'signup'"


def cache_evict(spark, sf):
    from palisade.sources.state import evicted

    return evicted(table(spark, sf, "events").select("event_id", "user_id"), "event_id")


EVICT_SQL = f"SELECT event_id, user_id FROM events ORDER BY event_id DESC LIMIT {CACHE_ROWS}"

QUERIES = {
    "path_classification": path_classification,
    "evidence_inventory": evidence_inventory,
    "month_list": month_list,
    "content_dedup": content_dedup,
    "checklist_rows": checklist_rows,
    "checklist_tree": checklist_tree,
    "sheet_dedup": sheet_dedup,
    "match_edges": match_edges,
    "match_ambiguous": match_ambiguous,
    "best_row": best_row,
    "match_assigned": match_assigned,
    "match_outcomes": match_outcomes,
    "companion_reconcile": companion_reconcile,
    "coverage_counts": coverage_counts,
    "coverage_tree": coverage_tree,
    "missing_alerts": missing_alerts,
    "missing_rollup": missing_rollup,
    "reconciliation_union": reconciliation_union,
    "coverage_summary": coverage_summary,
    "checklist_validation": checklist_validation,
    "manual_override": manual_override,
    "verdict_upsert": verdict_upsert,
    "cache_evict": cache_evict,
}
ORACLES = {
    "path_classification": PATH_SQL,
    "evidence_inventory": INVENTORY_SQL,
    "month_list": MONTHS_SQL,
    "content_dedup": DEDUP_SQL,
    "checklist_rows": ROWS_SQL,
    "checklist_tree": TREE_SQL,
    "sheet_dedup": SHEET_SQL,
    "match_edges": EDGES_SQL,
    "match_ambiguous": AMBIGUOUS_SQL,
    "best_row": BEST_SQL,
    "match_assigned": ASSIGNED_SQL,
    "match_outcomes": OUTCOMES_SQL,
    "companion_reconcile": COMPANION_SQL,
    "coverage_counts": COUNTS_SQL,
    "coverage_tree": COVERAGE_SQL,
    "missing_alerts": MISSING_SQL,
    "missing_rollup": ROLLUP_SQL,
    "reconciliation_union": RECONCILE_SQL,
    "coverage_summary": SUMMARY_SQL,
    "checklist_validation": VALIDATION_SQL,
    "manual_override": OVERRIDE_SQL,
    "verdict_upsert": UPSERT_SQL,
    "cache_evict": EVICT_SQL,
}
