"""String helpers as columns. Patterns are Java's; matching ignores ASCII case only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Every separator that ends a line.
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"
#: Systems by folder key, in order of precedence.
SYSTEMS = {"radio": "RADIO", "cctv": "CCTV", "epm": "EPM", "info": "INFO", "net": "NET", "pbx": "PBX", "audio": "AUDIO", "voice": "VOICE", "fac": "FAC", "nvr": "NVR", "fw": "FW", "gw": "GW"}
#: A date, a clock time, a dotted version.
NO_COUNT = r"\b[0-9]{1,4}[/-][0-9]{1,2}[/-][0-9]{1,4}\b|\b[0-9]{1,2}:[0-9]{2}(?::[0-9]{2})?\b|\b[0-9]{3,}\.[0-9]+\b"
#: Words that say nothing about which device is meant.
STOP_TOKENS = "pc client server system radio trellix mcafee clamwin nms user scan done yes no the and for rom".split()


def strings(*values: str) -> Column:
    return F.array(*[F.lit(v) for v in values])


def bound(value: Column, make) -> Column:
    """make(v) with v computed once; keeps long expressions over v out of the generated code's size limit."""
    return F.get(F.transform(F.array(value), make), F.lit(0))


def no_text(c: Column) -> Column:
    """c with the empty string as NULL."""
    return F.nullif(c, F.lit(""))


def first_group(text: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match, NULL without one (or if it is empty)."""
    return no_text(F.regexp_extract(text, pattern, group))


def all_groups(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.replace(text, F.lit(" "), F.lit(" ")), r"\s+", " "))


def lines_of(text: Column) -> Column:
    """Lines with something in them, inner blanks collapsed."""
    return F.filter(F.transform(F.split(text, LINE_END), collapsed), lambda line: line != "")


def to_long(digits: Column) -> Column:
    """A count with comma groups; NULL instead of an error beyond 64 bits."""
    return F.replace(digits, F.lit(","), F.lit("")).try_cast("bigint")


def labelled_int(text: Column, *labels: str) -> Column:
    """The number after the first label, in order of preference, that has one."""
    return F.coalesce(*[to_long(first_group(text, rf"(?i)\b{label}\b\s*(?::|=|-)?\s*([0-9][0-9,]*)")) for label in labels])


def labelled_ints(text: Column, *labels: str) -> Column:
    """All numbers after any of the labels."""
    return F.flatten(F.array(*[F.transform(all_groups(text, rf"(?i)\b{label}\b\s*(?::|=|-)?\s*([0-9][0-9,]*)"), to_long) for label in labels]))


def described(text: Column, label: str) -> Column:
    """The value of the last `label: value` line, without closing dots."""
    return F.regexp_replace(F.try_element_at(all_groups(text, rf"(?im)^\s*{label}\s*:\s*(.+?)\s*$"), F.lit(-1)), r"\.+$", "")


def compact(c: Column) -> Column:
    """Lower case, letters and digits only."""
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]", "")


def token_set(*values: Column) -> Column:
    """Sorted distinct words of two or more characters that tell devices apart, and each whole value compacted."""
    whole = F.filter(F.array(*[compact(v) for v in values]), lambda v: F.length(v) >= 3)
    words = F.flatten(F.array(*[all_groups(F.lower(F.coalesce(v, F.lit(""))), "([a-z0-9]+)") for v in values]))
    return F.sort_array(F.array_distinct(F.concat(whole, F.filter(words, lambda w: (F.length(w) >= 2) & ~w.isin(STOP_TOKENS)))))


def equipment_key(c: Column) -> Column:
    """Letter and digit runs joined, leading system names dropped."""
    spaced = F.array_join(all_groups(F.lower(F.coalesce(c, F.lit(""))), "([a-z]+|[0-9]+)"), " ")
    lead = "|".join([*SYSTEMS, "supervisory"])
    return F.replace(F.regexp_replace(spaced, rf"^(?:(?:{lead})(?: |$))+", ""), F.lit(" "), F.lit(""))


def site_code(name: Column) -> Column:
    """Three leading letters that are a word of their own, upper-cased; '' without."""
    return F.upper(F.regexp_extract(name, r"^\s*([A-Za-z]{3})\b", 1))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(file_name(path), r"(?<=.)(\.[^.]*)$", 1))


def shortened(text: Column, most: int, marker: str = "") -> Column:
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.left(text, F.lit(most)), F.lit(marker)))


def month_number(word: Column) -> Column:
    """1 to 12 for a month's name or abbreviation, in any case; NULL otherwise."""
    names = "january february march april may june july august september october november december".split()
    known = {n[:k]: i for i, n in enumerate(names, 1) for k in (3, len(n))} | {"sept": 9}
    return F.create_map(*[F.lit(x) for pair in known.items() for x in pair])[F.lower(word)]


def evidence_month(name: Column) -> Column:
    """struct(year, month) of a month folder: the last month word and the last four-digit number; NULL unless both."""
    words = all_groups(name, "([A-Za-z]+|[0-9]{4})")
    month = F.try_element_at(F.filter(F.transform(words, month_number), lambda m: m.isNotNull()), F.lit(-1))
    year = F.try_element_at(F.filter(words, lambda w: F.rlike(w, F.lit("^[0-9]{4}$"))), F.lit(-1)).try_cast("int")
    return F.when(month.isNotNull() & (year > 0), F.struct(year.alias("year"), month.alias("month")))


def percent(part: Column, whole: Column, half_even: bool = False) -> Column:
    share = F.when(whole > 0, part * 100.0 / whole).otherwise(0.0)
    return (F.bround(share) if half_even else F.floor(share + 0.5)).cast("int")


def isolated_count(c: Column) -> Column:
    """The number a text consists of, the letter O read as 0; NULL for anything else."""
    t = F.regexp_replace(F.trim(c), r"^[:=]\s*", "")
    return F.when(t.isin("o", "O"), F.lit(0).cast("bigint")).when(F.rlike(t, F.lit(r"\A[0-9]{1,7}\z")), t.try_cast("bigint"))


def is_no_count(c: Column) -> Column:
    """Whether a text shows a date, a clock time or a dotted version, so that its numbers are no counts."""
    return F.rlike(c, F.lit(NO_COUNT))
