r"""Scan times as people and screenshots write them, as columns; accepted only when nothing is guessed.

A text is cut into tokens: dates of three numbers, clock times, numbers, month names
and single signs. Week days and the word Time are dropped, blanks separate nothing, so
parts that recognition ran together come apart by themselves. The tokens' kinds, one letter each, make one
string, computed once; where it shows the beginning of one of these, and only there, the tokens are read:

    year-month-day [T] clock        day month year [clock]      month day clock year
    number/number/year clock [AM]   day month clock [year]      month day year

The first reading that names a real moment is the result, as precise as it is written. The month
of the evidence folder, where known, decides which of two numbers is the day, stands in for
a missing year, and rules out other months; without it two numbers must decide themselves.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from palisade.functions.text import bound, evidence_month, month_number

WEEKDAY, MONTH = "(?:mon|tue|wed|thu|fri|sat|sun)", "(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)"
YEAR_FIRST = r"[0-9]{4}[-/][0-9]{1,2}[-/][0-9]{1,2}"
#: Day, month and year by numbers; a separator that recognition lost or misread still ends a part.
YEAR_LAST = r"[0-9]{1,2}[/.-][0-9]{1,2}[/.-][0-9]{2,4}(?![0-9])|[0-9]{1,2}[/,][0-9]{1,2}/?[0-9]{4}"
CLOCK = r"[0-9]{1,2}[:.][0-9]{2}(?:[:.-][0-9]{2})?"
#: In block logs a day may run into the hour behind it.
DAY_OF_FUSED = r"[0-9]{1,2}(?=(?:[01][0-9]|2[0-3])[.:][0-9]{2})"
NOISE = rf"time\s*[:;.]?|{WEEKDAY}(?![a-z])|{WEEKDAY}(?={MONTH})"
MERIDIEM = r"[ap]\.?m(?![a-z])\.?"


def tokens(text: Column, fused: Column | bool = False) -> Column:
    """Lower-cased tokens of a text without noise, months as m and their number."""
    parts = lambda *more: F.lit("|".join([YEAR_FIRST, *more, YEAR_LAST, CLOCK, "[0-9]+", NOISE, MERIDIEM, "[a-z]+", r"\S"]))
    shape = F.when(fused, parts(DAY_OF_FUSED)).otherwise(parts()) if isinstance(fused, Column) else parts(*[DAY_OF_FUSED] * fused)
    found = F.filter(F.regexp_extract_all(F.lower(text), shape, F.lit(0)), lambda t: ~F.rlike(t, F.lit(rf"^(?:{NOISE})$")))
    month = lambda t: F.when(F.rlike(t, F.lit(rf"^{MONTH}[a-z]{{0,6}}$")), F.concat(F.lit("m"), month_number(F.left(t, F.lit(3))).cast("string")))
    return F.transform(found, lambda t: F.coalesce(month(t), t))


def clock_time(clock: Column, meridiem: Column) -> Column:
    """HH:mm or HH:mm:ss of a clock token; NULL unless the hour fits the twelve or twenty-four hours it claims."""
    part = lambda i: F.get(F.split(clock, "[:.-]"), F.lit(i)).try_cast("int")
    half = F.left(F.coalesce(meridiem, F.lit("")), F.lit(1))
    hour = F.when(half == "", F.when(part(0) < 24, part(0))).when(part(0).between(1, 12), part(0) % 12 + F.when(half == "p", 12).otherwise(0))
    fits = (part(1) < 60) & (F.coalesce(part(2), F.lit(0)) < 60)
    return F.when(fits & hour.isNotNull(), F.concat_ws(":", *[F.lpad(x.cast("string"), 2, "0") for x in (hour, part(1), part(2))]))


def calendar_day(year: Column, month: Column, day: Column, period: Column) -> Column:
    """yyyy-MM-dd, NULL for a day there is not, outside the period or, without one, in a year that can't be."""
    month = F.when(month.between(1, 12), month)
    known = F.when(period.isNull(), year.between(2000, F.year(F.current_date()) + 1)).otherwise((year == period["year"]) & (month == period["month"]))
    last = F.day(F.last_day(F.make_date(F.when(known, year), month, F.lit(1))))
    return F.when(known & day.between(1, last), F.concat_ws("-", year.cast("string"), *[F.lpad(x.cast("string"), 2, "0") for x in (month, day)]))


#: Beginnings of readings, as kinds of tokens.
STARTS = "^(?:it?[cb]|[xb][cb]|md[cb]y|mdy|dmy|dm[cb])"
#: What every text that holds a moment shows: two numbers with a sign between them, or a month.
SIGNS = rf"(?i)[0-9][-/.,:][0-9]|{MONTH}"


def _kinds(t: Column) -> Column:
    """One letter a token: i: year first, x: year last, c: clock, b: either of these two, d: one or two digits, y: four, m: month, t: the letter, a: AM or PM."""
    is_a = lambda token, shape: F.rlike(token, F.lit(f"^(?:{shape})$"))
    plain = lambda token: F.when(F.length(token) <= 2, "d").when(F.length(token) == 4, "y").otherwise("-")
    signed = (("i", YEAR_FIRST), ("c", "[0-9]{1,2}:[0-9]{2}(?:[:.-][0-9]{2})?|[0-9]{1,2}[.][0-9]{2}(?:[:-][0-9]{2})?"), ("b", "[0-9]{1,2}[.][0-9]{2}[.][0-9]{2}"), ("x", YEAR_LAST))

    def kind(token: Column) -> Column:
        number = F.when(is_a(token, "[0-9]+"), plain(token))
        for letter, shape in signed:
            number = number.when(is_a(token, shape), letter)
        word = F.when(is_a(token, "m[0-9]+"), "m").when(token == "t", "t").when(is_a(token, MERIDIEM), "a").otherwise("-")
        return F.when(F.left(token, F.lit(1)).between("0", "9"), number.otherwise("-")).otherwise(word)

    return F.array_join(F.transform(t, kind), "")


def _parts(t: Column, kinds: Column, i: Column, period: Column) -> Column:
    """struct(y, m, d, numbers, clock, meridiem) that the tokens from i on name; numbers: year, month and day are still three numbers."""
    none, number = F.lit(None).cast("string"), lambda k: F.get(t, i + k)
    folder_year = period["year"].cast("string")
    made = lambda y, m, d, clock=none, meridiem=none, numbers=none: F.struct(y.alias("y"), F.substring(m, 2, 2).alias("m"), d.alias("d"), numbers.alias("numbers"), clock.alias("clock"), meridiem.alias("meridiem"))

    def read(kind: Column) -> Column:
        starts = lambda shape: F.rlike(kind, F.lit(f"^{shape}"))
        return (
            F.when(starts("i[cb]"), made(none, none, none, number(1), none, number(0)))
            .when(starts("it[cb]"), made(none, none, none, number(2), none, number(0)))
            .when(starts("[xb][cb]"), made(none, none, none, number(1), F.when(starts("..a"), number(2)), number(0)))
            .when(starts("md[cb]y"), made(number(3), number(0), number(1), number(2)))
            .when(starts("mdy"), made(number(2), number(0), number(1)))
            .when(starts("dmy[cb]"), made(number(2), number(1), number(0), number(3)))
            .when(starts("dm[cb]y"), made(number(3), number(1), number(0), number(2)))
            .when(starts("dm[cb]"), made(folder_year, number(1), number(0), number(2)))
            .when(starts("dmy"), made(number(2), number(1), number(0)))
        )

    return bound(F.substring(kinds, i + 1, F.lit(4)), read)


def _day_of(p: Column, period: Column) -> Column:
    """struct(y, m, d) of parts. Of two numbers and a year the folder's month, or a number above twelve, or equal numbers tell the day from the month."""
    def told(n: Column) -> Column:
        a, b, c = (F.get(n, F.lit(k)) for k in range(3))
        year = F.when(c < 100, c + 2000).otherwise(c)
        month_first = F.when(period.isNotNull(), a == period["month"]).otherwise((b > 12) & (a <= 12) | (a == b))
        day_first = F.when(period.isNotNull(), b == period["month"]).otherwise((a > 12) & (b <= 12))
        day = lambda y, m, d: F.struct(y.alias("y"), m.alias("m"), d.alias("d"))
        return F.when(a > 999, day(a, b, c)).when(month_first, day(year, a, b)).when(day_first, day(year, b, a))

    split = F.regexp_replace(p["numbers"], "^([0-9]{1,2})[/,]([0-9]{1,2})([0-9]{4})$", "$1/$2/$3")
    numbers = F.transform(F.split(split, "[/,.-]"), lambda x: x.try_cast("int"))
    whole = lambda c: p[c].try_cast("int").alias(c)
    return F.when(p["numbers"].isNotNull(), bound(numbers, told)).otherwise(F.struct(whole("y"), whole("m"), whole("d")))


def _reading(t: Column, kinds: Column, i: Column, period: Column) -> Column:
    """The moment that the tokens from i on name, or NULL."""
    def said(p: Column) -> Column:
        day = bound(_day_of(p, period), lambda d: calendar_day(d["y"], d["m"], d["d"], period))
        return F.when(p["clock"].isNull(), day).otherwise(F.concat(day, F.lit(" "), clock_time(p["clock"], p["meridiem"])))

    return bound(_parts(t, kinds, i, period), said)


def found_datetime(text: Column, folder: Column, fused: Column | bool = False) -> Column:
    """The first valid moment in a text, '' without one."""
    month = evidence_month(F.coalesce(folder, F.lit("")))

    def first(t: Column, kinds: Column, of: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.greatest(F.size(t) - 1, F.lit(0))), lambda i: F.rlike(F.substring(kinds, i + 1, F.lit(4)), F.lit(STARTS)))
        return F.get(F.filter(F.transform(starts, lambda i: _reading(t, kinds, i, of)), lambda r: r.isNotNull()), F.lit(0))

    period = lambda make: bound(month, lambda m: bound(F.when(m["year"] >= 2000, m), make))
    read = lambda t: bound(_kinds(t), lambda kinds: F.when(F.rlike(kinds, F.lit(STARTS.replace("^", ""))), period(lambda of: first(t, kinds, of))))
    return F.coalesce(F.when(F.rlike(text, F.lit(SIGNS)), bound(tokens(text, fused), read)), F.lit(""))
