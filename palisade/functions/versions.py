"""Signature and definition versions as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from palisade.functions.text import first_group


def log_number(value: Column) -> Column:
    """The first blank-separated part with all but digits and dots removed, as a double."""
    return F.regexp_replace(F.get(F.split(value, " "), F.lit(0)), "[^0-9.]", "").try_cast("double")


def checklist_number(value: Column) -> Column:
    """The first decimal number, a comma read as a point."""
    return first_group(F.replace(value, F.lit(","), F.lit(".")), r"([0-9]+(?:\.[0-9]+)?)").try_cast("double")


def outdated(version: Column, threshold: Column) -> Column:
    return F.coalesce(log_number(version) < threshold, F.lit(False))


def same_version(a: Column, b: Column) -> Column:
    return F.coalesce(F.abs(log_number(a) - log_number(b)) < 0.0001, F.lit(False))
