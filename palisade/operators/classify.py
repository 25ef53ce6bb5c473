"""Vendor classification by weighted content rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.functions.text import strings

#: Vendor, pattern, weight, indicator.
RULES = [
    ("trellix_mcafee", r"\b(?:mcafee|trellix)\b", 5, "McAfee/Trellix product name"),
    ("trellix_mcafee", r"\bamcore content version\b", 4, "AMCore field"),
    ("trellix_mcafee", r"\bendpoint security threat prevention custom properties\b", 4, "ePO Threat Prevention report"),
    ("trellix_mcafee", r"\bnumber of threat events\b", 6, "ePO threat-event total"),
    ("trellix_mcafee", r"\bods(?:b1)?\.ods\.activity\b|\bmfetp\b", 5, "OnDemandScan activity syntax"),
    ("trellix_mcafee", r"\bvirus\s*scan enterprise\b|\bantivirus dat version\b", 4, "VirusScan Enterprise fields"),
    ("trellix_mcafee", r"\bfiles with detections\b|\bfile detections\b", 3, "McAfee scan-summary fields"),
    ("trend_micro", r"\btrend micro\b|\bdeep security\b", 6, "Trend Micro/Deep Security product name"),
    ("trend_micro", r"\bagent/appliance event", 4, "Deep Security event structure"),
    ("trend_micro", r"\bmanual malware scan (?:started|completed)\b", 4, "Trend Micro scan event"),
    ("trend_micro", r"\bevent id\b.*\b900[12]\b", 3, "Trend Micro scan event ID"),
    ("clamwin", r"\bclamwin\b", 6, "ClamWin product name"),
    ("clamwin", r"\bknown viruses\b", 4, "ClamWin signature field"),
    ("clamwin", r"\binfected files\s*:", 5, "ClamWin result field"),
    ("clamwin", r"\bvirus db version\b", 3, "ClamWin definition field"),
    ("symantec", r"\bsymantec\b|\bendpoint protection\b", 6, "Symantec product name"),
    ("symantec", r"\btotal risks? detected\b|\brisks? found\b", 4, "Symantec result field"),
    ("symantec", r"\bvirus definitions?\b", 3, "Symantec definition field"),
]
#: Vendor, columns of a CSV header, weight, indicator.
HEADER_RULES = [
    ("trend_micro", ("time", "level", "event id", "event", "event origin", "target", "description"), 6, "Deep Security System Events CSV columns"),
    ("generic_antivirus", ("started on", "completed", "computer", "status", "total files", "infected"), 6, "Completed-scan CSV columns"),
]
VENDORS = ("clamwin", "generic_antivirus", "symantec", "trellix_mcafee", "trend_micro")
LEAST, GAP, FULL, READ_CHARS = 5, 2, 12, 2_000_000


def hits(text: Column, headers: Column | None = None) -> Column:
    """array<struct(vendor, weight, indicator)> of the rules that hold, in one pass over the row."""
    seen = F.left(text, F.lit(READ_CHARS))
    names = F.transform(F.coalesce(headers, F.array().cast("array<string>")), lambda h: F.lower(F.trim(h))) if headers is not None else F.array().cast("array<string>")
    if headers is not None:
        seen = F.when(F.size(names) > 0, F.concat(F.array_join(headers, " "), F.lit("\n"), seen)).otherwise(seen)
    rule = lambda v, w, i: F.struct(F.lit(v).alias("vendor"), F.lit(w).alias("weight"), F.lit(i).alias("indicator"))
    found = [F.when(F.rlike(seen, F.lit(f"(?is){p}")), rule(v, w, i)) for v, p, w, i in RULES]
    found += [F.when(F.size(F.array_except(strings(*columns), names)) == 0, rule(v, w, i)) for v, columns, w, i in HEADER_RULES]
    return F.filter(F.array(*found), lambda h: h.isNotNull())


def classified(files: DataFrame, text: str = "text", headers: str | None = None) -> DataFrame:
    """files with classification struct(vendor, confidence, scores, indicators, conflicts, reason, requires_review)."""
    df = files.withColumn("_hits", hits(F.col(text), F.col(headers) if headers else None))
    score = lambda v: F.aggregate(F.filter("_hits", lambda h: h["vendor"] == v), F.lit(0), lambda a, h: a + h["weight"])
    df = df.withColumn("_ranked", F.array_sort(F.array(*[F.struct((-score(v)).alias("order"), F.lit(v).alias("vendor"), score(v).alias("score")) for v in VENDORS])))
    top, second = F.get("_ranked", F.lit(0)), F.get("_ranked", F.lit(1))
    total = F.aggregate("_ranked", F.lit(0), lambda a, r: a + r["score"])
    indicators = F.transform(F.filter("_hits", lambda h: h["vendor"] == top["vendor"]), lambda h: h["indicator"])
    none = F.array().cast("array<string>")
    rivals = F.transform(F.filter(F.slice("_ranked", 2, len(VENDORS) - 1), lambda r: r["score"] >= LEAST), lambda r: r["vendor"])
    unknown, tie = top["score"] < LEAST, (second["score"] >= LEAST) & (top["score"] - second["score"] <= GAP)
    out = F.struct(
        F.when(unknown, "unknown").when(tie, "ambiguous").otherwise(top["vendor"]).alias("vendor"),
        F.when(unknown, 0.0).when(tie, F.round(top["score"] / F.greatest(total, F.lit(1)), 3)).otherwise(F.round(F.least(F.lit(1.0), top["score"] / FULL), 3)).alias("confidence"),
        F.map_from_arrays(F.transform("_ranked", lambda r: r["vendor"]), F.transform("_ranked", lambda r: r["score"])).alias("scores"),
        F.when(unknown, none).otherwise(indicators).alias("indicators"),
        F.when(unknown, none).when(tie, F.array(top["vendor"], second["vendor"])).otherwise(rivals).alias("conflicts"),
        F.when(unknown, "No supported vendor signature reached the minimum score.").when(tie, "Two vendor signatures scored similarly.").otherwise(F.array_join(indicators, "; ")).alias("reason"),
        (unknown | tie).alias("requires_review"),
    )
    return df.withColumn("classification", out).drop("_hits", "_ranked")
