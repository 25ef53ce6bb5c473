"""Dates and times that logs carry, as columns of TIMESTAMP_NTZ: logs name no zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from palisade.functions.text import all_groups, bound, collapsed, first_group, month_number

#: Where a text shows a date with a time.
DATE_IN_TEXT = (
    r"(?i)\b(?:[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}\s+[0-9]{1,2}:[0-9]{2}(?::[0-9]{2})?\s*(?:AM|PM)|"
    r"[A-Za-z]+\s+[0-9]{1,2},\s+[0-9]{4}\s+[0-9]{1,2}:[0-9]{2}:[0-9]{2}|"
    r"[0-9]{4}-[0-9]{2}-[0-9]{2}\s+[0-9]{2}:[0-9]{2}:[0-9]{2})\b"
)
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"


def iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def _made(text: Column, pattern: str, order: str) -> Column:
    """A timestamp from the groups of pattern, named by order: Y M D h m s p (p: AM or PM), B for a month's name."""
    raw = {name: F.regexp_extract(text, pattern, i) for i, name in enumerate(order, 1)}
    number = {n: c.try_cast("int") for n, c in raw.items() if n not in "pB"}
    year = number["Y"]
    # two digits: 69 to 99 are of the last century
    year = F.when(F.length(raw["Y"]) == 2, F.when(year >= 69, year + 1900).otherwise(year + 2000)).otherwise(year)
    hour = number["h"]
    if "p" in raw:
        hour = F.when(hour.between(1, 12), hour % 12 + F.when(F.upper(raw["p"]) == "PM", 12).otherwise(0))
    month = month_number(raw["B"]) if "B" in raw else number["M"]
    return F.when(F.rlike(text, F.lit(pattern)), F.try_make_timestamp_ntz(year, month, number["D"], hour, number["m"], F.coalesce(number.get("s", F.lit(0)), F.lit(0)).cast("decimal(16,6)")))


def vendor_datetime(value: Column) -> Column:
    """The first of the vendors' formats that fits the whole value; NULL without."""
    return bound(collapsed(value), _vendor_datetime)


def _vendor_datetime(text: Column) -> Column:
    return F.coalesce(
        _made(text, r"(?i)^([0-9]{1,2})/([0-9]{1,2})/([0-9]{4}|[0-9]{2}) ([0-9]{1,2}):([0-9]{1,2})(?::([0-9]{1,2}))? (AM|PM)$", "MDYhmsp"),
        _made(text, r"(?i)^([0-9]{4})/([0-9]{1,2})/([0-9]{1,2}) ([0-9]{1,2}):([0-9]{1,2})(?::([0-9]{1,2}))? (AM|PM)$", "YMDhmsp"),
        _made(text, rf"(?i)^({MONTHS}) ([0-9]{{1,2}}), ([0-9]{{4}}) ([0-9]{{1,2}}):([0-9]{{1,2}}):([0-9]{{1,2}})$", "BDYhms"),
        _made(text, r"^([0-9]{4})-([0-9]{1,2})-([0-9]{1,2}) ([0-9]{1,2}):([0-9]{1,2}):([0-9]{1,2})$", "YMDhms"),
        _made(text, r"^([0-9]{1,2})/([0-9]{1,2})/([0-9]{4}|[0-9]{2}) ([0-9]{1,2}):([0-9]{1,2}):([0-9]{1,2})$", "MDYhms"),
    )


def ctime(value: Column) -> Column:
    """`Tue Dec 19 10:23:33 2023`; NULL otherwise."""
    return bound(collapsed(value), _ctime)


def _ctime(text: Column) -> Column:
    return _made(text, r"(?i)^(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun) (Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec) ([0-9]{1,2}) ([0-9]{1,2}):([0-9]{2}):([0-9]{2}) ([0-9]{4})$", "BDhmsY")


def dates_in(text: Column) -> Column:
    return all_groups(text, DATE_IN_TEXT, 0)


def duration_seconds(value: Column) -> Column:
    """Plain seconds, m:s or h:m:s; NULL otherwise."""
    v = F.replace(F.trim(value), F.lit(","), F.lit(""))
    parts = F.transform(F.split(v, ":"), lambda p: p.try_cast("bigint"))
    return F.when(F.rlike(v, F.lit("^[0-9]+(:[0-9]+){0,2}$")), F.aggregate(parts, F.lit(0).cast("bigint"), lambda a, p: a * 60 + p))


def date_candidates(value: Column) -> Column:
    """Sorted distinct dates a value may mean: ISO, both orders of day and month, or a month's name before a time."""
    return bound(F.coalesce(value, F.lit("")), _date_candidates)


def _date_candidates(text: Column) -> Column:
    def date(pattern: str, y: int, m: int, d: int, named: bool = False) -> Column:
        part = lambda i: F.regexp_extract(text, pattern, i)
        year = part(y).try_cast("int")
        month = F.coalesce(month_number(part(m)), month_number(F.left(part(m), F.lit(3)))) if named else part(m).try_cast("int")
        return F.when(F.rlike(text, F.lit(pattern)), F.try_make_timestamp_ntz(F.when(year < 100, year + 2000).otherwise(year), month, part(d).try_cast("int"), F.lit(0), F.lit(0), F.lit(0).cast("decimal(16,6)")).cast("date"))

    slashes = r"\b([0-9]{1,2})[/-]([0-9]{1,2})[/-]([0-9]{2,4})\b"
    named = r"(?i)\b(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun)?\s*([A-Za-z]{3,9})\s+([0-9]{1,2})\s+[0-9]{1,2}:[0-9]{2}:[0-9]{2}\s+([0-9]{4})\b"
    found = F.array(date(r"\b([0-9]{4})-([0-9]{1,2})-([0-9]{1,2})\b", 1, 2, 3), date(slashes, 3, 1, 2), date(slashes, 3, 2, 1), date(named, 3, 1, 2, True))
    return F.array_sort(F.array_distinct(F.filter(found, lambda d: d.isNotNull())))


def in_month(ts: Column, month: Column) -> Column:
    """Whether ts lies in the struct(year, month); true where either is unknown."""
    return F.coalesce((F.year(ts) == month["year"]) & (F.month(ts) == month["month"]), F.lit(True))


def first_in_text(text: Column) -> Column:
    return first_group(text, f"({DATE_IN_TEXT})")
