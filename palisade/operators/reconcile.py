"""Verdicts held against companions, the checklist, people and a second reader."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.functions import dates, versions
from palisade.operators.verdicts import CLEAN, MANUAL, NOT_SCANNED, THREATS, scan_status


def with_companions(entries: DataFrame) -> DataFrame:
    """entries (path, system, role, status): a properties report takes its verdict from the threat reports of its system."""
    threat = entries.where("role = 'epo_threat_report'").groupBy("system").agg(F.collect_set("status").alias("found"), F.array_sort(F.collect_list("path")).alias("companion_paths"))
    df = entries.join(threat, "system", "left")
    companion = F.when(F.col("found").isNull(), "missing").when(F.array_contains("found", THREATS), "threats_found").when((F.size("found") == 1) & F.array_contains("found", CLEAN), "clean").otherwise("needs_review")
    dat = F.col("role") == "epo_dat_report"
    status = F.when(companion == "threats_found", THREATS).when(companion == "clean", CLEAN).otherwise(MANUAL)
    return df.withColumns({"companion": F.when(dat, companion), "status": F.when(dat, status).otherwise(F.col("status")), "companion_paths": F.when(dat, F.coalesce("companion_paths", F.array().cast("array<string>")))}).drop("found")


def mismatches(status: Column, system: Column, chk_dat: Column, log_dat: Column, chk_date: Column, log_date: Column, virus_found: Column) -> Column:
    """What the checklist says otherwise; never changes the verdict."""
    scanned = status != NOT_SCANNED
    expected, actual = versions.checklist_number(chk_dat), versions.checklist_number(log_dat)
    exempt = (system == "RADIO") & (expected < 1000) & (actual >= 1000)
    no_dat = scanned & (chk_dat != "") & ((log_dat == "Unknown") | actual.isNull())
    dat = scanned & (chk_dat != "") & (log_dat != "Unknown") & ~F.coalesce(exempt, F.lit(False)) & (F.abs(expected - actual) >= 0.01)
    no_date = scanned & (chk_date != "") & (log_date == "Unknown")
    same = F.arrays_overlap(dates.date_candidates(chk_date), dates.date_candidates(log_date))
    date = scanned & (chk_date != "") & (log_date != "Unknown") & ~F.coalesce(same, F.lit(False))
    says = F.lower(F.trim(virus_found))
    lines = [
        F.when(no_dat, F.lit("DAT version not detected in scanned log")),
        F.when(~no_dat & dat, F.concat(F.lit("DAT mismatch: checklist "), chk_dat, F.lit(", scanned "), log_dat)),
        F.when(no_date, F.lit("Scan date not detected in scanned log")),
        F.when(date, F.concat(F.lit("Scan date mismatch: checklist "), chk_date, F.lit(", scanned "), log_date)),
        F.when(says.isin("no", "none", "0") & (status == THREATS), F.lit("Checklist says no virus found, scanned log reports threat")),
        F.when(says.isin("yes", "y", "true") & (status == CLEAN), F.lit("Checklist says virus found, scanned log is clean")),
    ]
    return F.filter(F.array(*lines), lambda m: m.isNotNull())


def with_manual_verdicts(entries: DataFrame, verdicts: DataFrame) -> DataFrame:
    """entries (path, content_sha256, status, is_outdated, parse_failed) with people's verdicts (path, content_sha256, verdict) on the same bytes."""
    right = verdicts.where("verdict is not null").select("path", "content_sha256", F.col("verdict").alias("verification"))
    df = entries.join(right, ["path", "content_sha256"], "left")  # a NULL hash joins nothing
    judged = F.col("verification")
    df = df.withColumn("status", F.when(judged == "safe", CLEAN).when(judged == "unsafe", THREATS).otherwise(F.col("status"))).withColumn("is_outdated", F.when(judged.isNotNull(), False).otherwise(F.col("is_outdated")))
    return df.withColumn("scan_status", scan_status(F.col("status"), F.col("is_outdated"), F.col("parse_failed"), judged))
