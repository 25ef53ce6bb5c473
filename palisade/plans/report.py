"""The monthly report: a handful of small tables, then one HTML page."""

from __future__ import annotations

import datetime
import html

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CARDS = [
    ("Evidence files", "evidence_files"),
    ("Checklist expected", "expected_evidence"),
    ("Confirmed coverage", "confirmed_evidence"),
    ("Missing", "missing_evidence"),
    ("Coverage unknown", "unknown_coverage"),
    ("Findings", "finding_files"),
    ("Needs review", "review_files"),
    ("Scan failures", "failed_files"),
    ("Not OCR-scanned", "not_scanned_files"),
]


def report_tables(entries: DataFrame, missing: DataFrame, reconciliation: DataFrame, thresholds: DataFrame) -> dict[str, DataFrame]:
    """Titles to tables; every column is a string ready to show."""
    text = lambda df, **cols: df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for n, c in cols.items()])
    review = entries.where(F.col("scan_status").isin("needs_review", "scan_failed")).withColumn("reason", F.array_join("verification_reasons", "; "))
    place = reconciliation.withColumn("place", F.coalesce("subsystem", "path"))
    return {
        "Configured signature thresholds": text(thresholds.where("engine <> 'zero_threat_confidence'").orderBy("engine").withColumn("name", F.initcap("engine")), Engine="name", Minimum="value"),
        "Detected findings": text(entries.where("scan_status = 'finding_detected'").orderBy(F.lower("path")), System="system", Evidence="filename", Verdict="status", DAT="dat_version", Scan_date="last_scan", Trace_path="path"),
        "Manual review and parser failures": text(review.orderBy(F.lower("path")), System="system", Evidence="filename", State="scan_status", Reason="reason", Trace_path="path"),
        "Missing evidence": text(missing.orderBy("system", "subsystem"), System="system", Location="subsystem", Expected="expected", Found="found", Missing="missing"),
        "Unresolved reconciliation": text(place.orderBy("type", "system", "place"), Type="type", System="system", Location_or_path="place", Expected="expected", Found="found", Unresolved="unresolved", Reason="reason"),
    }


def limitations(summary: dict, checklist_error: str = "") -> list[str]:
    notes = [f"Checklist unavailable or invalid: {checklist_error}"] if checklist_error else []
    for name, note in (
        ("unknown_coverage", "Consolidated evidence could not be mapped to every expected endpoint."),
        ("not_scanned_files", "Some image evidence has not completed OCR; this report is not a complete detection review."),
        ("failed_files", "One or more evidence files failed safe parsing and require manual review."),
    ):
        notes += [note] if summary.get(name) else []
    return notes or ["No automated parser can replace review of original evidence and endpoint security tooling."]


def cell(value) -> str:
    return html.escape(str(value)) if value not in (None, "") else "Not available"


def _table(df: DataFrame) -> str:
    head = "".join(f"<th>{cell(c.replace('_', ' '))}</th>" for c in df.columns)
    body = "".join("<tr>" + "".join(f"<td>{cell(v)}</td>" for v in row) + "</tr>" for row in df.toLocalIterator())
    return f"<table><thead><tr>{head}</tr></thead><tbody>{body}</tbody></table>" if body else "<p>No entries.</p>"


def monthly_html(month: str, summary: DataFrame, tables: dict[str, DataFrame], positive_confidence: float = 0.9, zero_confidence: float = 0.9, checklist_error: str = "", generated: datetime.datetime | None = None) -> str:
    """The page; rows stream to the driver table by table."""
    one = summary.first().asDict()
    stamp = (generated or datetime.datetime.now(datetime.UTC)).isoformat()
    cards = "".join(f"<div><span>{cell(label)}</span> <strong>{cell(one[name])}</strong></div>" for label, name in CARDS)
    notes = "".join(f"<li>{cell(n)}</li>" for n in limitations(one, checklist_error))
    parts = "".join(f"<h2>{cell(title)}</h2>{_table(df)}" for title, df in tables.items())
    state = "Coverage complete" if one["complete"] else "Coverage incomplete - review required"
    return (
        f'<!doctype html><html lang="en"><head><meta charset="utf-8"><title>{cell(month)} evidence report</title></head><body>'
        f"<h1>Monthly evidence report</h1><p>Evidence month: {cell(month)}. Generated UTC: {cell(stamp)}.</p><p>{state}</p>{cards}"
        f"<h2>Scope and limitations</h2><ul>{notes}</ul><p>Explicit zero-threat confidence: {zero_confidence:.0%}. Positive-threat confidence: {positive_confidence:.0%}.</p>{parts}</body></html>"
    )


def text_summary(text: str, most: int = 250_000) -> str:
    return text if len(text) <= most else text[:most] + "\n\n[Output truncated for safe display.]"
