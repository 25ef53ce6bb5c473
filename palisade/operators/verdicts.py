"""From scan runs to a file's verdict, which is never clean while anything is unknown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palisade.functions import dates

# Verdicts and scan states.
THREATS, CLEAN, MANUAL, NOT_SCANNED = "Threats Found", "Clean", "Manual Verification Needed", "Not Scanned"


def threat_state(positive: Column, resolved_zero: Column, unresolved: Column) -> Column:
    """positive, explicit_zero or unknown."""
    return F.when(positive, "positive").when(resolved_zero & ~unresolved, "explicit_zero").otherwise("unknown")


def in_evidence_month(runs: DataFrame, month: Column, file: str = "source_file_id") -> DataFrame:
    """Runs of the evidence month and undated ones; a file none of whose runs qualifies keeps them all. Adds month_warning."""
    time = F.coalesce("scan_completion_time", "scan_start_time")
    every = Window.partitionBy(file)
    df = runs.withColumn("_in", dates.in_month(time, month) | month.isNull()).withColumn("_n_in", F.count_if("_in").over(every)).withColumn("_n", F.count("*").over(every))
    warning = F.when(F.col("_n_in") == 0, F.concat(F.lit("None of the "), F.col("_n").cast("string"), F.lit(" parsed scan run(s) fell within the evidence month; showing all runs.")))
    warning = warning.when(F.col("_n_in") < F.col("_n"), F.concat((F.col("_n") - F.col("_n_in")).cast("string"), F.lit(" scan run(s) outside the evidence month were excluded.")))
    return df.withColumn("month_warning", warning).where("_in or _n_in = 0").drop("_in", "_n_in", "_n")


def file_verdicts(runs: DataFrame, file: str = "source_file_id") -> DataFrame:
    """file, status, threat_state, dat_version, last_scan, reasons, n_runs; the latest run names version and time, the first of equal times."""
    time = F.coalesce("scan_completion_time", "scan_start_time")
    order = F.struct(F.coalesce(dates.iso(time), F.lit("")).alias("t"), (-F.col("run_index")).alias("i"))
    doubtful = F.col("threats_detected").isNull() | (F.col("normalized_status") == "Requires review")
    df = runs.groupBy(file).agg(
        F.bool_or(F.coalesce(F.col("threats_detected") > 0, F.lit(False))).alias("_positive"),
        F.bool_or(F.coalesce(F.col("threats_detected") == 0, F.lit(False))).alias("_zero"),
        F.bool_or(F.col("threats_detected").isNull()).alias("_open"),
        F.max_by(F.struct("definition_version", dates.iso(time).alias("time")), order).alias("_latest"),
        F.array_sort(F.collect_list(F.when(doubtful, F.struct("run_index", "warnings")))).alias("_doubts"),
        F.count("*").alias("n_runs"),
    )
    state = threat_state(F.col("_positive"), F.col("_zero"), F.col("_open"))
    return df.select(
        file,
        F.when(state == "positive", THREATS).when(state == "explicit_zero", CLEAN).otherwise(MANUAL).alias("status"),
        state.alias("threat_state"),
        F.coalesce("_latest.definition_version", F.lit("Unknown")).alias("dat_version"),
        F.coalesce("_latest.time", F.lit("Unknown")).alias("last_scan"),
        F.array_distinct(F.flatten(F.transform("_doubts", lambda d: d["warnings"]))).alias("reasons"),
        "n_runs",
    )


def scan_status(status: Column, outdated: Column, parse_failed: Column, verdict: Column) -> Column:
    """One of six, by precedence; verdict is a person's: safe, unsafe or NULL."""
    return (
        F.when(F.coalesce(parse_failed, F.lit(False)), "scan_failed")
        .when(status == NOT_SCANNED, "not_scanned")
        .when((F.coalesce(verdict, F.lit("")) == "unsafe") | (status == THREATS), "finding_detected")
        .when((status == MANUAL) | F.coalesce(outdated, F.lit(False)), "needs_review")
        .when(verdict == "safe", "verified_safe")
        .otherwise("healthy")
    )
