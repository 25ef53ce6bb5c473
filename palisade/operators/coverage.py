"""Coverage: what evidence there is, against what the checklist expects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.functions.text import file_name, site_code


def _at(*places: tuple[str | Column, str | Column]) -> Column:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.array(*[F.struct(lit(s).alias("system"), lit(loc).alias("location")) for s, loc in places])


def places(entries: DataFrame) -> DataFrame:
    """entries (path, display, system, subsystem, type, pdf_names array) with places array<struct(system, location)> and unknown, the system whose coverage can't be told."""
    system, sub, pdf = F.col("system"), F.col("subsystem"), F.col("type") == "PDF"
    low = F.lower("display")
    names = F.coalesce("pdf_names", F.array().cast("array<string>"))
    has = lambda *words: F.rlike(low, F.lit("|".join(words)))
    site = site_code(file_name(F.col("path")))
    none = F.array().cast("array<struct<system:string,location:string>>")
    sites = F.filter(F.transform(names, lambda n: F.upper(F.get(F.split(n, "-"), F.lit(0)))), lambda n: n != "")
    depot = sub == "Depot"
    hq = F.when(has("hmi1"), "Office 1").when(has("hmi2"), "Office 2").when(has("hmi3"), "Ops Center(PFR)").otherwise("HQ East")
    found = (
        F.when(pdf & (system == "EPM"), F.array_repeat(F.struct(F.lit("EPM").alias("system"), F.lit("Report").alias("location")), F.greatest(F.size(names), F.lit(1))))
        .when(pdf & (system == "INFO"), F.transform(sites, lambda s: F.struct(F.lit("INFO").alias("system"), s.alias("location"))))
        .when(pdf & (system == "CCTV"), _at(("CCTV", "Report")))
        .when((system == "RADIO") & (sub == "Site Radio"), F.concat(F.when(site != "", _at(("RADIO", site))).otherwise(none), _at(("RADIO", "Site"))))
        .when((system == "RADIO") & depot, F.concat(_at(("RADIO", "Depot")), F.when(has("as1", "as2"), _at(("RADIO", "Operations Center"))).when(has("crs", "gw", "nms"), _at(("RADIO", "HQ East"))).otherwise(none)))
        .when((system == "PBX") & depot, _at(("PBX", "HQ East"), ("PBX", "Ops Center")))
        .when((system == "AUDIO") & depot, _at(("AUDIO", "HQ East")))
        .when((system == "NET") & depot, _at(("NET", F.when(has("03"), "Data Center").otherwise("HQ East"))))
        .when((system == "VOICE") & depot, _at(("VOICE", F.when(has("server"), "HQ East").otherwise("Ops Center"))))
        .when(system == "VOICE", _at(("VOICE", F.when(sub == "Base System", "Site U").otherwise(sub))))
        .when((system == "FAC") & sub.isin("Base System", "Depot"), _at(("FAC", hq)))
        .when(system.isin("FW", "NVR") & depot, _at((system, "Ops Center")))
        .when(system == "GW", _at(("GW", F.when(F.startswith(low, F.lit("occ")), "Ops Center").when(F.startswith(low, F.lit("site")), "Site B").otherwise(sub))))
        .otherwise(_at((system, sub)))
    )
    unknown = F.when(pdf & system.isin("EPM", "CCTV"), system).when(pdf & (system == "INFO") & (F.size(names) == 0), system)
    return entries.withColumns({"places": found, "unknown": unknown})


def counts(placed: DataFrame) -> DataFrame:
    """system, location, n."""
    return placed.select(F.explode("places").alias("p")).groupBy("p.system", "p.location").agg(F.count("*").alias("n"))


def unknown_systems(placed: DataFrame) -> DataFrame:
    return placed.where("unknown is not null").select(F.col("unknown").alias("system")).distinct()


def tree_status(expected: DataFrame, found: DataFrame, unknown: DataFrame) -> DataFrame:
    """expected (system, location, expected, ...) with found, missing, extra, coverage_status, unresolved_count; found + missing + unresolved_count = expected."""
    df = expected.join(found, ["system", "location"], "left").join(unknown.withColumn("is_unknown", F.lit(True)), "system", "left")
    raw, need = F.coalesce("n", F.lit(0)), F.col("expected")
    have = F.least(raw, need)
    rest = F.greatest(need - have, F.lit(0))
    status = F.when(have >= need, "present").when(F.coalesce("is_unknown", F.lit(False)), "unknown").when(have > 0, "partial").otherwise("missing")
    df = df.withColumns({"found": have, "missing": F.when(status.isin("partial", "missing"), rest).otherwise(0), "extra": F.greatest(raw - need, F.lit(0)), "coverage_status": status, "unresolved_count": F.when(status == "unknown", rest).otherwise(0)})
    return df.drop("n", "is_unknown")


def missing_alerts(tree: DataFrame) -> DataFrame:
    return tree.where("coverage_status in ('missing', 'partial') and missing > 0").select("system", F.col("location").alias("subsystem"), "expected", "found", "missing")


def missing_rollup(alerts: DataFrame) -> DataFrame:
    """Per system and in total: places and pieces missing; repeated alerts of a place count once."""
    once = alerts.groupBy("system", "subsystem").agg(F.first("expected").alias("expected"), F.first("found").alias("found"), F.first("missing").alias("missing"))
    return once.rollup("system").agg(F.count("*").alias("places"), F.sum("expected").alias("expected"), F.sum("found").alias("found"), F.sum("missing").alias("missing"), F.grouping("system").alias("is_total")).withColumn("system", F.coalesce("system", F.lit("TOTAL")))


def reconciliation(entries: DataFrame, tree: DataFrame) -> DataFrame:
    """Evidence without a checklist row, and places whose coverage can't be told."""
    loose = entries.where("row_id is null").select(F.lit("unmapped_evidence").alias("type"), "system", "path", F.col("match_reason").alias("reason"))
    vague = tree.where("coverage_status = 'unknown'").select(F.lit("unknown_coverage").alias("type"), "system", F.col("location").alias("subsystem"), "expected", "found", F.col("unresolved_count").alias("unresolved"), F.lit("Consolidated evidence exists, but endpoint coverage could not be mapped safely.").alias("reason"))
    return loose.unionByName(vague, allowMissingColumns=True)


def summary(tree: DataFrame, entries: DataFrame, checklist_valid: bool = True) -> DataFrame:
    """One row: four sums over places, eight counts over files, and whether the month is complete."""
    sums = tree.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(a) for c, a in (("expected", "expected_evidence"), ("found", "confirmed_evidence"), ("missing", "missing_evidence"), ("unresolved_count", "unknown_coverage"))])
    of = lambda s: F.count_if(F.col("scan_status") == s)
    files = entries.agg(
        F.count("*").alias("evidence_files"),
        F.count_if(F.col("row_id").isNotNull()).alias("matched_files"),
        F.count_if(F.col("row_id").isNull()).alias("unmatched_files"),
        F.count_if("match_ambiguous").alias("ambiguous_files"),
        of("not_scanned").alias("not_scanned_files"),
        of("scan_failed").alias("failed_files"),
        of("needs_review").alias("review_files"),
        of("finding_detected").alias("finding_files"),
    )
    both = sums.join(files)  # one row each
    done = F.lit(checklist_valid) & (F.col("missing_evidence") + F.col("unknown_coverage") + F.col("failed_files") + F.col("not_scanned_files") + F.col("ambiguous_files") == 0)
    return both.withColumn("complete", done)
