import datetime
import warnings

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablescour.errors import CleanError
from tablescour.functions.dates import with_parsed_dates
from tablescour.functions.strftime import check_format, strftime

# One value per line: layouts and near misses.
VALUES = """2025-01-15|2025-1-5|2025/01/15|2025.03.05|2025-01/15|2025-13-01|2025-30-02
2025-01-15 10:30|2025-01-15T10:30:15.123456|2025-01-15T10:30:15.1234567|2025-01-15 24:00
2025-01-15 10:30Z|2025-01-15T10:30:00+02:00|2025-01-15 10:30 PM|2025-01-15 13:30 PM
2025-01-15 10PM|01/20/2025 10:30|1/20/2025 10:30:15 AM|01.20.2025|20.01.2025|1.2.2025|1-2-25
1/2/25|1.2.25|13/2/25|25/12/31|31/12/25|12/31/99|25-12-31|99-01-02|2025-1|2025/01|2025.01
13/2025|01/2025|1-2025|01.2025|Jan 2025|January 2025|Jan-2025|2025 Jan|Jan 25|5 Jan|5 Jan 25
25 Jan 05|Jan 5 25|Jan. 5, 2025|5th of March 2025|3rd March 2025|Mon, 03 Mar 2025
Monday 3 March 2025|Mon 03/03/2025|2025 Jan 5|2025-Jan-05|5-Jan-2025|5/Jan/2025|Jan/5/2025
Jan-5-2025|5Jan2025|05JAN2025|Sept 28, 2025|Sep 28 2025 10:00|28 Sept 2025 10:00 PM|20250115
20250115103000|202501151030|202501|250115|2025|0000|0001|120.50|555-010-5678|5551234567
02/30/2025|31/31/2025|0/1/2025|1/0/2025|00/00/0000|0000-01-01|2025-00-10|2025-1-1 1:2|2025-1-1 1:02
2025-01-15 10|2025-01-15 |Feb 29 2025|29 Feb 2024|1 2 2025|2025 01 15|15 01 2025|01 15 2025
1,2,2025|Jan,5,2025|5 january, 2025|2025-01-15 10:30:61|2025-01-15 10:61|2025-01-15T10|2025-015
2025-W03|2025-W03-1|2025001|1/20/2025Z|12-2025-01|-2025-01-15|2025-01-15 10:30 am|1/2/2025 0:00
Sat Jan 25 2025|Thu Jan 25 10:00:00 2025|2025-01-15 10:30 UTC|1/20/99|1/20/75|1/20/76|1/20/77
1 Jan 76|Jan 5th, 2025|Jan 5th 2025|5 Mai 2025|2 may 2025|Mar 32 2025|2025-01-15 10:30:15.5
2025/13/01|2025/1|2025.1|13.2025|1.13.2025|true|a|t|m|1a|1d|12 AM|AM|y|mar|may|sat|monday|5|12
99|123|1234.5|12345|123456|1234567|1e5|+2025|-1|1/2|13/45|10-11|v1.2.3|1.2.3|192.168.1.1
1-800-555-1212|Customer 2025|#2025|12/2025/01|May 5, 2025 at 10:30|5 May 2025, 10:30
05-05-2025T10:30|nan|None|ORD-1001|hello world|05/03/2025|25/12/2024|13-02-2025|20251301
  2025-01-15  |2025-02-29|2024-02-29|12/31/1999 23:59:59.999999|Dec 31 1999 11:59:59 pm"""
CASES = [v for line in VALUES.split("\n") for v in line.split("|")]


def expected(value, day_first):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        stamp = pd.to_datetime(
            pd.Series([value], dtype=object), errors="coerce", format="mixed", dayfirst=day_first
        )[0]
    if pd.isna(stamp):
        return None
    return stamp.tz_localize(None).floor("us").to_pydatetime(warn=False)


def parse(spark, values, day_first=False):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    out = with_parsed_dates(df, {"t": "v"}, day_first).orderBy("i").collect()
    return [r.t for r in out]


@pytest.mark.parametrize("day_first", [False, True])
def test_agrees_with_the_mixed_parser(spark, day_first):
    got = parse(spark, CASES, day_first)
    wrong = [
        (v, g, e) for v, g in zip(CASES, got) if g != (e := expected(v, day_first))
    ]
    assert wrong == []


def test_every_day_in_every_layout(spark):
    days = pd.date_range("1969-12-28", "2031-01-05", freq="37D")
    layouts = ["%Y-%m-%d", "%m/%d/%Y", "%b %d, %Y", "%d %B %Y", "%Y.%m.%d", "%d-%b-%Y", "%Y%m%d"]
    values = [(d, d.strftime(f)) for d in days for f in layouts]
    got = parse(spark, [v for _, v in values])
    assert [g for g in got] == [d.to_pydatetime() for d, _ in values]


def test_missing_values_stay_missing(spark):
    assert parse(spark, [None, "", "   "]) == [None, None, None]


def test_two_digit_years_follow_the_reference_year(spark):
    df = spark.createDataFrame([("1/2/70",)], "v string")
    near = with_parsed_dates(df, {"t": "v"}, reference_year=1990).first().t
    far = with_parsed_dates(df, {"t": "v"}, reference_year=2025).first().t
    assert (near.year, far.year) == (1970, 2070)


FORMATS = [
    "%Y-%m-%d", "%d/%m/%y", "%B %d, %Y", "%a %A %b", "%j %w %u", "%H:%M:%S.%f", "%I %p",
    "%U|%W|%V|%G", "%c", "%x %X", "100%% %Z%z", "plain", "%Y%Y",
]


def test_formats_print_like_the_standard_library(spark):
    stamps = [
        datetime.datetime(2025, 1, 5, 0, 0, 0),
        datetime.datetime(2024, 12, 30, 13, 5, 9, 123456),
        datetime.datetime(2021, 1, 3, 12, 0, 0, 7),
        datetime.datetime(2000, 2, 29, 23, 59, 59, 999999),
    ]
    df = spark.createDataFrame([(t,) for t in stamps], "t timestamp_ntz")
    row_wise = df.select(*[strftime(F.col("t"), f).alias(str(i)) for i, f in enumerate(FORMATS)])
    for stamp, row in zip(stamps, row_wise.collect()):
        assert list(row) == [stamp.strftime(f) for f in FORMATS]


@pytest.mark.parametrize("fmt", ["%Q-bogus", "%Y-%o-%d", "%Y-%", "%"])
def test_bad_formats_are_named(fmt):
    with pytest.raises(CleanError) as error:
        check_format(fmt)
    assert error.value.code == "invalid_date_format"
