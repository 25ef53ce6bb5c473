import datetime

import pytest
from pyspark.sql import functions as F

from palisade.functions import dates, scan_dates, text, versions
from palisade.operators import scan_text as T


def values(spark, expr, *inputs):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
    return [r.v for r in df.select("i", expr(F.col("x")).alias("v")).orderBy("i").collect()]


def test_vendor_datetime(spark):
    got = values(spark, lambda c: dates.iso(dates.vendor_datetime(c)), "6/9/2026 1:07:52 AM", "6/9/26 12:00 PM", "May 4, 2026 10:00:00", "2026-05-04 10:00:00", "6/9/69 1:00:00", "31/2/2026 10:00:00", "6/9/2026 13:07 PM", "nothing", None, "2026/5/4 1:02 am")
    assert got == ["2026-06-09 01:07:52", "2026-06-09 12:00:00", "2026-05-04 10:00:00", "2026-05-04 10:00:00", "1969-06-09 01:00:00", None, None, None, None, "2026-05-04 01:02:00"]


def test_ctime_and_duration(spark):
    assert values(spark, lambda c: dates.iso(dates.ctime(c)), "Mon May 04 10:00:00 2026", "Mon Foo 04 10:00:00 2026") == ["2026-05-04 10:00:00", None]
    assert values(spark, dates.duration_seconds, "90", "1:30", "1:00:30", "1,000", "x", "1:2:3:4") == [90, 90, 3630, 1000, None, None]


def test_date_candidates(spark):
    d = datetime.date
    got = values(spark, dates.date_candidates, "6/5/2026", "2026-05-06 10:00", "31/12/25", "Tue May 05 10:00:00 2026", "no date", None)
    assert got == [[d(2026, 5, 6), d(2026, 6, 5)], [d(2026, 5, 6)], [d(2025, 12, 31)], [d(2026, 5, 5)], [], []]


def test_labelled_int(spark):
    got = values(spark, lambda c: text.labelled_int(c, "infected files?", "detections"), "Infected files: 1,204", "detections -5", "Infected file = 3\nDetections: 9", "none", "Detections: 99999999999999999999999")
    assert got == [1204, 5, 3, None, None]


def test_described_takes_the_last(spark):
    assert values(spark, lambda c: text.described(c, "Time"), "Time: a.\nx\n Time : b...", "x") == ["b", None]


def test_keys(spark):
    assert values(spark, text.compact, "A-b 1", None) == ["ab1", ""]
    assert values(spark, text.equipment_key, "RADIO PC 12", "supervisory gw 3", "pc-7") == ["pc12", "3", "pc7"]
    assert values(spark, lambda c: text.token_set(c), "PC 12 HQ") == [["12", "hq", "pc12hq"]]
    assert values(spark, text.site_code, " abc 1.png", "ABCD 1", "1ab") == ["ABC", "", ""]
    assert values(spark, text.extension, "a/b.PNG", "a/.hidden", "a/b") == [".png", "", ""]


def test_months(spark):
    got = values(spark, text.evidence_month, "May 2026", "2025 sept", "notes", "June")
    assert [tuple(g) if g else None for g in got] == [(2026, 5), (2025, 9), None, None]


def test_counts_and_percent(spark):
    assert values(spark, text.isolated_count, " : 12 ", "O", "12 files", "12345678") == [12, 0, None, None]
    assert values(spark, text.is_no_count, "1/2/2026", "10:30", "6127.0", "12") == [True, True, True, False]
    assert values(spark, lambda c: text.percent(c.cast("int"), F.lit(200)), "1", "3", "0") == [1, 2, 0]
    assert values(spark, lambda c: text.percent(c.cast("int"), F.lit(200), half_even=True), "1", "3", "5") == [0, 2, 2]


def test_versions(spark):
    assert values(spark, versions.log_number, "6127.0000 (May 5)", "Updated: 3", "1.2.3") == [6127.0, None, None]
    assert values(spark, versions.checklist_number, "6,127", "", "v 12") == [6.127, None, 12.0]
    assert values(spark, T.clean_version, "04954.0", "1.2.3", "4954 12", "123450", "99", "4954-7") == ["4954.0", "", "4954.12", "12345.0", "", "4954.7"]


@pytest.mark.parametrize(
    ("value", "month", "expected"),
    [
        ("6/5/2026 1:07:52 AM", "June 2026", "2026-06-05 01:07:52"),
        ("6/5/2026 1:07:52 AM", "May 2026", "2026-05-06 01:07:52"),
        ("6/5/2026 1:07 AM", "", ""),
        ("25/5/2026 13:07", "", "2026-05-25 13:07"),
        ("31/2/2026 10:00", "", ""),
        ("Tue May 05 10:00:00 2026", "June 2026", ""),
        ("5 May 2026", "May 2026", "2026-05-05"),
        ("25/5/2026 13:07 PM", "May 2026", ""),
        ("2026-05-04T10:00:00Z", "May 2026", "2026-05-04 10:00:00"),
        ("MonMay 4 10.00.00 2026", "May 2026", "2026-05-04 10:00:00"),
        ("", "May 2026", ""),
    ],
)
def test_scan_datetime(spark, value, month, expected):
    assert values(spark, lambda c: scan_dates.found_datetime(c, F.lit(month)), value) == [expected]


def test_find_datetime_takes_the_first_valid(spark):
    assert values(spark, lambda c: scan_dates.found_datetime(c, F.lit("May 2026")), "bad 31/2/2026 10:00 then 4 May 2026 and 5 May 2026") == ["2026-05-04"]
    assert values(spark, lambda c: scan_dates.found_datetime(c, F.lit("May 2026"), fused=True), "May 1303.15.17 2026") == ["2026-05-13 03:15:17"]


def test_dates_from_parts_run_together(spark):
    got = values(spark, lambda c: scan_dates.found_datetime(c, F.lit("May 2026")), "12May2026 10:11", "5/122026 9:05 PM", "4 May 10:00", "13/13/2026 10:00", "29/2/2026 10:00 30 May 2026", "4 May, 2026", "4 May 2026 25:00")
    assert got == ["2026-05-12 10:11", "2026-05-12 21:05", "2026-05-04 10:00", "", "2026-05-30", "", ""]
    assert values(spark, lambda c: scan_dates.found_datetime(c, F.lit("")), "4 May 10:00", "10:00 4/4/26 11:30 P.M.", "12345-05-04 10:00", "29/2/2024 12:00 AM") == ["", "2026-04-04 23:30", "", "2024-02-29 00:00"]


def test_found_datetime_column(spark):
    got = values(spark, lambda c: scan_dates.found_datetime(c, F.lit("May 2026")), "done 2026-05-04 10:00:00", "no digits", None)
    assert got == ["2026-05-04 10:00:00", "", ""]
