"""Filters, facets and tallies over finished entries, as a dashboard asks for them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.functions.text import no_text, percent
from palisade.operators.verdicts import CLEAN, MANUAL, NOT_SCANNED, THREATS

IMAGE_TYPES, TEXT_TYPES = ("PNG", "JPG", "JPEG", "GIF", "BMP"), ("TXT", "LOG", "CSV")
STATUS_FACETS = {"clean": CLEAN, "verification": MANUAL, "threats": THREATS, "not-scanned": NOT_SCANNED}


def of_type(bucket: str) -> Column:
    kind = F.col("type")
    return {"images": kind.isin(*IMAGE_TYPES), "text": kind.isin(*TEXT_TYPES), "pdf": kind == "PDF"}.get(bucket, F.lit(True))


def matches(query: str) -> Column:
    """Case-blind substring search over what a row shows; an empty query matches."""
    q = F.lit(query.strip().lower())
    shown = ["system", "filename", "dat_version", "last_scan", "dat_version_candidate", "last_scan_candidate"]
    hit = F.lit(False)
    for name in shown:
        hit |= F.contains(F.lower(F.coalesce(F.col(name).cast("string"), F.lit(""))), q)
    return hit | F.coalesce(F.exists("verification_reasons", lambda r: F.contains(F.lower(r), q)), F.lit(False))


def filtered(entries: DataFrame, system: str = "all", bucket: str = "all", status: str = "all", search: str = "") -> DataFrame:
    df = entries if system == "all" else entries.where(F.col("system") == system)
    df = df.where(of_type(bucket))
    df = df.where(F.col("status") == STATUS_FACETS[status]) if status in STATUS_FACETS else df
    return df.where(matches(search)) if search.strip() else df


def facets(entries: DataFrame, system: str = "all") -> DataFrame:
    """Counts of the type buckets; only the system filter applies to them."""
    df = entries if system == "all" else entries.where(F.col("system") == system)
    counts = {"all": F.count("*"), "images": F.count_if(of_type("images")), "text": F.count_if(of_type("text")), "pdf": F.count_if(of_type("pdf"))}
    one = df.agg(*[c.alias(k) for k, c in counts.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("bucket"), F.col(k).alias("n")) for k in counts])).alias("x")).select("x.*")


def tallies(entries: DataFrame) -> DataFrame:
    of = lambda s: F.count_if(F.col("status") == s)
    return entries.agg(F.count("*").alias("total"), of(CLEAN).alias("clean"), of(THREATS).alias("threats"), of(MANUAL).alias("manual"), of(NOT_SCANNED).alias("not_scanned"), F.count_if("is_outdated").alias("outdated")).withColumn("scanned_percent", percent(F.col("total") - F.col("not_scanned"), F.col("total")))


def action_required(entries: DataFrame) -> DataFrame:
    """Entries that need a person, with the label of their list item."""
    need = F.col("is_outdated") | F.col("status").isin(MANUAL, THREATS)
    label = F.when(F.col("status") == MANUAL, "Manual verification").otherwise("Outdated signature")
    detail = F.when(F.col("is_outdated"), F.col("dat_version")).otherwise(F.col("type"))
    return entries.where(need).withColumns({"action": label, "detail": detail})


def ai_review_queue(entries: DataFrame) -> DataFrame:
    return entries.where((F.col("status") == MANUAL) & of_type("images"))


def displayed(entries: DataFrame) -> DataFrame:
    """What a table shows: the confirmed value, else the candidate, else a dash; repeated evidence; the first reason and how many more."""
    shown = lambda sure, maybe: F.coalesce(F.nullif(F.col(sure), F.lit("Unknown")), F.concat(F.lit("Candidate: "), no_text(F.col(maybe))), F.lit("—"))
    more = F.size("verification_reasons") - 1
    reason = F.coalesce(F.try_element_at("verification_reasons", F.lit(1)), F.lit(""))
    return entries.withColumns({
        "shown_dat": shown("dat_version", "dat_version_candidate"),
        "shown_scan": shown("last_scan", "last_scan_candidate"),
        "repeated": F.when(F.col("date_evidence_count") >= 3, F.concat(F.lit("repeated "), F.col("date_evidence_count").cast("string"))),
        "shown_reason": F.when(more > 0, F.concat(reason, F.lit(" +"), more.cast("string"), F.lit(" more"))).otherwise(reason),
    })


def selected_system(systems: Column, name: Column) -> Column:
    """The named row of a consolidated report, else its first."""
    return F.coalesce(F.try_element_at(F.filter(systems, lambda s: s["name"] == name), F.lit(1)), F.try_element_at(systems, F.lit(1)))


def threats_by_system(entries: DataFrame) -> DataFrame:
    return entries.groupBy("system").agg(F.count_if(F.col("status") == THREATS).alias("threats"))


def node_totals(tree: DataFrame) -> DataFrame:
    return tree.groupBy("system").agg(*[F.sum(c).alias(c) for c in ("expected", "found", "missing")], F.sum("unresolved_count").alias("unknown"))


def overlay(entries: DataFrame, tree: DataFrame) -> DataFrame:
    """Entries to tree places by the first folder their display names, compared without case and signs."""
    from palisade.functions.text import compact

    folder = compact(F.element_at(F.split(F.regexp_extract("display", r"^\[([^\]]*)\]", 1), "/"), -1))
    return entries.withColumn("place_key", folder).join(tree.select("system", "location", compact(F.col("location")).alias("place_key")), ["system", "place_key"])


def progress(outcomes: DataFrame, total: int) -> DataFrame:
    """Completed, succeeded, failed, the first twenty failures, percent (half to even), outcome of outcomes (seq, name, failed)."""
    counts = outcomes.agg(F.count("*").alias("seen"), F.count_if(~F.col("failed")).alias("succeeded"), F.count_if("failed").alias("failed"), F.lit(None).cast("array<string>").alias("files"))
    few = outcomes.where("failed").orderBy("seq", "name").limit(20)  # the bound is the feature
    few = few.agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", "name"))), lambda x: x["name"]).alias("files"))
    none = F.lit(None).cast("long")
    both = counts.unionByName(few.select(none.alias("seen"), none.alias("succeeded"), none.alias("failed"), "files"))
    df = both.agg(F.max("seen").alias("seen"), F.max("succeeded").alias("succeeded"), F.max("failed").alias("failed"), F.first("files", ignorenulls=True).alias("failed_files"))
    done = F.least("seen", F.lit(total))
    return df.select(F.lit(total).alias("total"), done.alias("completed"), "succeeded", "failed", "failed_files", percent(done, F.lit(total), half_even=True).alias("percent"), F.when(F.col("failed") > 0, "completed_with_errors").otherwise("completed").alias("outcome"))
