"""A second reader's JSON replies: accepted only where their own evidence shows the value, then held against the first reading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.functions.scan_dates import found_datetime
from palisade.functions.versions import log_number
from palisade.operators.verdicts import CLEAN, MANUAL, THREATS

# Fixed values.
DAT_WORDS = r"\b(?:amcore|dat|signature|virus\s+db|definitions?)\b"
THREAT_WORDS = r"\b(?:infected\s+files?|detections?|threats?|files?\s+with\s+detections?)\b"
FIELDS = ("dat_version", "scan_date", "threat_count", "dat_evidence", "scan_date_evidence", "threat_evidence")


def short(value: Column, most: int = 500) -> Column:
    return F.left(F.trim(F.regexp_replace(F.coalesce(value, F.lit("")), r"\s+", " ")), F.lit(most))


def validated(replies: DataFrame) -> DataFrame:
    """id, the FIELDS and error of replies (id, reply, folder): the first JSON object of a reply, fences and trailing prose aside.

    A field counts only when its value also stands in its labelled evidence; a reply that holds no object has an error instead.
    """
    schema = ", ".join(f"{f} string" for f in (*FIELDS, "broken"))
    body = F.nullif(F.regexp_extract("reply", r"(?s)(\{.*)$", 1), F.lit(""))
    r = replies.select("id", F.coalesce("folder", F.lit("")).alias("folder"), body.alias("body"), F.from_json(body, schema, {"columnNameOfCorruptRecord": "broken"}).alias("r"))
    error = F.when(F.col("body").isNull(), "Local AI response did not contain JSON.").when(F.col("r").isNull() | F.col("r.broken").isNotNull(), "Local AI response held no whole JSON object.")
    r = r.select("id", "folder", error.alias("error"), *[short(F.col(f"r.{f}"), {"dat_version": 80, "scan_date": 100}.get(f, 500)).alias(f) for f in FIELDS])
    digits = lambda c: F.regexp_replace(c, "[^0-9]", "")
    words = lambda c, pattern: F.rlike(c, F.lit(f"(?i){pattern}"))
    dat_ok = log_number(F.col("dat_version")).isNotNull() & words(F.col("dat_evidence"), DAT_WORDS) & F.contains(digits(F.col("dat_evidence")), digits(F.col("dat_version")))
    date = found_datetime(F.col("scan_date"), F.col("folder"))
    date_ok = date == found_datetime(F.col("scan_date_evidence"), F.col("folder"))
    n = F.when(F.rlike("threat_count", F.lit("^[0-9]{1,7}$")), F.col("threat_count").try_cast("int"))
    behind = F.regexp_extract("threat_evidence", rf"(?i)^.*?{THREAT_WORDS}(.*)$", 1)
    count_ok = (n <= 1_000_000) & (F.regexp_extract(behind, r"(?<![0-9])([0-9]{1,7})(?![0-9])", 1).try_cast("int") == n)
    told = lambda c: F.when(F.col("error").isNull(), c)
    return r.select("id", told(F.when(dat_ok, F.col("dat_version")).otherwise("")).alias("dat_version"), told(F.when(date_ok, date).otherwise("")).alias("scan_date"), told(F.when(count_ok, n)).alias("threat_count"), *[told(F.col(f)).alias(f) for f in FIELDS[3:]], "error")


def reconciled(first: DataFrame, second: DataFrame) -> DataFrame:
    """first (id, status, dat_version, last_scan, threat_result, candidate_result, dat_candidate, date_candidate, n_open_reasons) with second (validated()).

    Agreement settles a candidate; disagreement, or a zero that only the second
    reader saw, goes to a person; a positive count always stands.
    """
    b = second.select("id", F.col("dat_version").alias("b_dat"), F.col("scan_date").alias("b_date"), F.col("threat_count").alias("b_count"))
    df = first.join(b, "id", "left")
    number = lambda c: F.regexp_replace(F.get(F.split(c, " "), F.lit(0)), "[^0-9.]", "").try_cast("double")
    same = F.coalesce(F.abs(number(F.col("b_dat")) - number(F.when(F.col("dat_version") != "Unknown", F.col("dat_version")).otherwise(F.col("dat_candidate")))) < 0.0001, F.lit(False))
    has_dat, has_date = F.coalesce("b_dat", F.lit("")) != "", F.coalesce("b_date", F.lit("")) != ""
    no_dat, no_date = F.col("dat_version") == "Unknown", F.col("last_scan") == "Unknown"
    dat_agrees, dat_conflict = has_dat & no_dat & (F.col("dat_candidate") != "") & same, has_dat & ~no_dat & ~same
    date_agrees, date_conflict = has_date & no_date & (F.col("date_candidate") == F.col("b_date")), has_date & ~no_date & (F.col("last_scan") != F.col("b_date"))
    zero_seen = (F.col("threat_result") == "explicit_zero") | (F.col("candidate_result") == "explicit_zero")
    zero = (F.col("threat_result") == "explicit_zero") | (F.coalesce(F.col("b_count") == 0, F.lit(False)) & zero_seen)
    lone_zero = F.coalesce(F.col("b_count") == 0, F.lit(False)) & ~zero_seen
    positive = (F.col("threat_result") == "positive") | (F.col("status") == THREATS) | F.coalesce(F.col("b_count") > 0, F.lit(False))
    dat, date = F.when(dat_agrees, F.col("dat_candidate")).otherwise(F.col("dat_version")), F.when(date_agrees, F.col("date_candidate")).otherwise(F.col("last_scan"))
    settled = dat_agrees.cast("int") + date_agrees.cast("int") + (F.coalesce(F.col("b_count") == 0, F.lit(False)) & zero_seen).cast("int")
    open_reasons = F.greatest(F.col("n_open_reasons") - settled, F.lit(0)) + lone_zero.cast("int") + dat_conflict.cast("int") + date_conflict.cast("int")
    clean = zero & (dat != "Unknown") & (date != "Unknown") & ~dat_conflict & ~date_conflict & (open_reasons == 0)
    status = F.when(positive, THREATS).when(clean, CLEAN).otherwise(MANUAL)
    status = F.when(F.col("b_dat").isNull() & F.col("b_date").isNull() & F.col("b_count").isNull(), F.col("status")).otherwise(status)
    return df.select("id", status.alias("status"), dat.alias("dat_version"), date.alias("last_scan"), (dat_conflict | date_conflict).alias("conflict"), settled.alias("agreements"), open_reasons.alias("open_reasons"))


def cache_key(content_sha256, model: str, prompt: str, dimension: int):
    return F.sha2(F.concat_ws("|", F.coalesce(content_sha256, F.lit("")), F.lit(model), F.lit(prompt), F.lit(str(dimension))), 256)
