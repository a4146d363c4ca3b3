"""Mixed-layout date parsing as a few small projections over string columns.

A value is cleaned once, its clock part is cut off, and the rest is cut into at most
three fields; which field is year, month or day follows from their shapes. Each
projection reads the columns of the one before, so nothing is evaluated twice and no
formatter is tried in vain. Results are TIMESTAMP_NTZ, hence free of session zones.
"""

from __future__ import annotations

import datetime
from collections.abc import Mapping

from pyspark.sql import DataFrame

from tablescour.columns import quoted
from tablescour.functions import patterns
from tablescour.functions.patterns import sql_raw

# Month words a field may hold; the place in each row of twelve counts.
_MONTH_WORDS = ",".join(
    [
        "jan", "feb", "mar", "apr", "may", "jun",
        "jul", "aug", "sep", "oct", "nov", "dec",
        "january", "february", "march", "april", "may", "june",
        "july", "august", "september", "october", "november", "december",
        "?", "?", "?", "?", "?", "?", "?", "?", "sept",
    ]
)
# Weekday words that may lead a date.
_WEEKDAY_WORDS = (
    "mon|tue|tues|wed|thu|thur|thurs|fri|sat|sun"
    "|monday|tuesday|wednesday|thursday|friday|saturday|sunday"
)

_ISO_DAY = r"^(?!0000)\d{4}-\d{2}-\d{2}$"
_BLANKS = patterns.WHITESPACE_CLASS[:-1] + ",]+"
# Parts that say nothing: a leading weekday, ordinal endings, "of" and "at".
_FILLER = rf"^(?:{_WEEKDAY_WORDS})\.? +|(?<=\d)(?:st|nd|rd|th)\b| (?:of|at)(?= )"
# Hours that stand alone; they get their minutes so that one clock pattern is enough.
_LONE_HOUR = (
    r"(?<=[ t])\d{1,2}(?= ?(?:am|pm)$)|(?<=\dt)\d{1,2}$|(?<=^\d{4}-\d{1,2}-\d{1,2} )\d{1,2}$"
)
# Places where a blank is missing: before a clock after T, and around "5jan2025".
_SEAMS = r"(?<=\d)t(?=\d{1,2}:)|(?<=^\d{1,2})(?=[a-z]{3})|(?<=^\d{1,2}[a-z]{3,9})(?=\d)"
_CLOCK = (
    r"(?:^| )(\d{1,2}):(\d{1,2})(?::(\d{1,2})(?:[.](\d{1,9}))?)? ?(am|pm)?"
    r"(?: ?(?:z|utc|gmt|[+-]\d{2}:?\d{2}))?(?= |$)"
)
_RUN_TOGETHER = r"^(?:\d{6}|\d{8}|\d{12}|\d{14})$"
_FIELDS = r"^(?:\d{1,4}|[a-z]{3,9})(?:(?:[-/]|[. ]+)(?:\d{1,4}|[a-z]{3,9})){0,2}$"
# Decimal numbers that must not pass for a month and a year.
_DECIMAL_LOOKS = r"^\d{1,2}\.\d{4}$|^(?!1[7-9]\d\d|2[01]\d\d)\d{4}\.\d{1,2}$"


# Each stage maps its output columns to SQL over the columns of the stage before; {v} is
# the source column. Regular expressions are filled in as raw SQL literals.
# Plain ISO days, the common case, are done at once; all later stages see NULL for them.
_ISO = {
    "iso": f"""
        CASE WHEN {{v}} RLIKE {sql_raw(_ISO_DAY)} THEN try_cast({{v}} AS TIMESTAMP_NTZ) END"""
}
_CLEANED = {
    "text": f"""
        CASE WHEN __date_iso IS NULL AND {{v}} RLIKE {sql_raw(r'[0-9]')} AND length({{v}}) >= 4
             THEN lower(btrim(regexp_replace({{v}}, {sql_raw(_BLANKS)}, ' '))) END"""
}

# Drop filler and set missing blanks; the look-behinds run only where they can hit.
_SPACED = {
    "text": f"""
        CASE WHEN __date_text RLIKE '[a-z]' THEN
               CASE WHEN __date_text RLIKE {sql_raw(r"[0-9]t[0-9]|^[0-9]{1,2}[a-z]")}
                    THEN regexp_replace(regexp_replace(__date_timed, {sql_raw(_FILLER)}, ''),
                                        {sql_raw(_SEAMS)}, ' ')
                    ELSE regexp_replace(__date_timed, {sql_raw(_FILLER)}, '') END
             ELSE __date_timed END"""
}
_TIMED = {
    "text": "__date_text",
    "timed": f"""
        CASE WHEN NOT contains(__date_text, ':')
                  AND __date_text RLIKE {sql_raw(r"[t ][0-9]{1,2}(?: ?[ap]m)?$")}
             THEN regexp_replace(__date_text, {sql_raw(_LONE_HOUR)}, '$0:00')
             ELSE __date_text END""",
}

_CLOCK_CUT = {
    "day": f"""
        CASE WHEN contains(__date_text, ':')
             THEN trim(regexp_replace(__date_text, {sql_raw(_CLOCK)}, '')) ELSE __date_text END""",
    "clock": f"""
        CASE WHEN contains(__date_text, ':')
             THEN regexp_extract(__date_text, {sql_raw(_CLOCK)}, 0) END""",
}

_FIELD_LIST = {
    "fields": f"""
        CASE WHEN __date_day RLIKE {sql_raw(_RUN_TOGETHER)} THEN
               CASE WHEN length(__date_day) = 6
                    THEN array(left(__date_day, 2), substr(__date_day, 3, 2), right(__date_day, 2))
                    ELSE array(left(__date_day, 4), substr(__date_day, 5, 2),
                               substr(__date_day, 7, 2)) END
             WHEN __date_day RLIKE {sql_raw(_FIELDS)}
                  AND NOT __date_day RLIKE {sql_raw(_DECIMAL_LOOKS)}
             THEN split(__date_day, {sql_raw(r"[-/]|[. ]+")}) END""",
    "clock": f"""
        CASE WHEN __date_day RLIKE {sql_raw(r"^(?:[0-9]{12}|[0-9]{14})$")}
             THEN concat_ws(':', substr(__date_day, 9, 2), substr(__date_day, 11, 2),
                            nullif(substr(__date_day, 13, 2), ''))
             ELSE __date_clock END""",
}


def _field(k: int) -> str:
    return f"get(__date_fields, {k})"


# Month words become their number; the shape has one letter per field: a month word,
# 4 digits, 1-2 digits, or x.
_WORDS = {
    **{f"f{k}": _field(k) for k in range(3)},
    **{
        f"w{k}": f"CASE WHEN {_field(k)} < ':' THEN 0 "
        f"ELSE find_in_set({_field(k)}, '{_MONTH_WORDS}') END"
        for k in range(3)
    },
    "clock": f"""
        CASE WHEN __date_clock IS NOT NULL THEN array(
            {", ".join(f"regexp_extract(__date_clock, {sql_raw(_CLOCK)}, {k})" for k in range(1, 6))}
        ) END""",
}
_SHAPED = {
    "shape": "concat_ws('', "
    + ", ".join(
        f"CASE WHEN __date_w{k} > 0 THEN 'm' WHEN length(__date_f{k}) = 4 THEN '4' "
        f"WHEN length(__date_f{k}) <= 2 THEN '2' WHEN __date_f{k} IS NOT NULL THEN 'x' END"
        for k in range(3)
    )
    + ")",
    **{
        f"n{k}": f"CASE WHEN __date_w{k} > 0 THEN (__date_w{k} - 1) % 12 + 1 "
        f"ELSE try_cast(__date_f{k} AS INT) END"
        for k in range(3)
    },
    "clock": "__date_clock",
}


def _roles(day_first: bool) -> dict[str, str]:
    """Which field is year (y), month (m) and day (d), by shape and size."""
    if day_first:
        iso = "CASE WHEN __date_n1 > 12 AND __date_n2 <= 12 THEN 'ydm' ELSE 'ymd' END"
        year_led = "CASE WHEN __date_n2 <= 12 THEN 'ydm' ELSE 'ymd' END"
        day_led = "__date_n0 > 12 OR __date_n1 <= 12"
    else:
        iso = year_led = "'ymd'"
        day_led = "__date_n0 > 12"
    return {
        "roles": f"""CASE
            WHEN __date_shape = '4' AND __date_clock IS NULL AND __date_n0 >= 1000 THEN 'y'
            WHEN __date_shape = '422' THEN {iso}
            WHEN __date_shape = '222' AND __date_n0 > 31 THEN {year_led}
            WHEN __date_shape IN ('224', '222') THEN CASE WHEN {day_led} THEN 'dmy' ELSE 'mdy' END
            WHEN __date_shape IN ('4m', '42') THEN 'ym'
            WHEN __date_shape IN ('m4', '24') THEN 'my'
            WHEN __date_shape = 'm42' OR (__date_shape = 'm22' AND __date_n1 > 31) THEN 'myd'
            WHEN __date_shape IN ('m24', 'm22') THEN 'mdy'
            WHEN __date_shape = '4m2' OR (__date_shape = '2m2' AND __date_n0 > 31) THEN 'ymd'
            WHEN __date_shape IN ('2m4', '2m2') THEN 'dmy'
            WHEN __date_shape = '24m' OR (__date_shape = '22m' AND __date_n1 > 31) THEN 'dym'
            WHEN __date_shape IN ('42m', '22m') THEN 'ydm' END""",
        "numbers": "array(__date_n0, __date_n1, __date_n2)",
        "short": "NOT contains(__date_shape, '4')",
        "clock": "__date_clock",
    }


def _parts(year_now: int) -> dict[str, str]:
    def role(letter: str) -> str:
        return f"get(__date_numbers, locate('{letter}', __date_roles) - 1)"

    pivot, century = year_now % 100 + 50, year_now - year_now % 100
    return {
        "year": f"""{role("y")} + CASE WHEN NOT __date_short THEN 0
            WHEN {role("y")} >= {pivot} THEN {century - 100}
            WHEN {role("y")} < {pivot - 100} THEN {century + 100} ELSE {century} END""",
        "month": f"coalesce({role('m')}, 1)",
        "day": f"coalesce({role('d')}, 1)",
        "hour": """CASE WHEN __date_clock IS NULL THEN 0
            WHEN __date_clock[4] = '' THEN try_cast(__date_clock[0] AS INT)
            WHEN try_cast(__date_clock[0] AS INT) BETWEEN 1 AND 12
            THEN try_cast(__date_clock[0] AS INT) % 12
                 + CASE WHEN __date_clock[4] = 'pm' THEN 12 ELSE 0 END END""",
        "minute": """CASE WHEN __date_clock IS NULL THEN 0
            ELSE try_cast(__date_clock[1] AS INT) END""",
        "second": """CASE WHEN __date_clock IS NULL THEN 0BD ELSE try_cast(concat(
            '0', __date_clock[2], '.', rpad(left(__date_clock[3], 6), 6, '0')
            ) AS DECIMAL(16, 6)) END""",
    }


# The partition number keeps filters on the result from being rewritten stage by stage;
# see columns.evaluated_once.
_STAMP = """
    CASE WHEN spark_partition_id() >= 0 AND __date_iso IS NOT NULL THEN __date_iso
         WHEN __date_year BETWEEN 1 AND 9999 AND __date_hour BETWEEN 0 AND 23
              AND __date_minute BETWEEN 0 AND 59 AND __date_second < 60
         THEN try_make_timestamp_ntz(__date_year, __date_month, __date_day, __date_hour,
                                     __date_minute, CAST(__date_second AS DECIMAL(16, 6))) END"""


def with_parsed_dates(
    df: DataFrame,
    columns: Mapping[str, str],
    day_first: bool = False,
    reference_year: int | None = None,
) -> DataFrame:
    """Add one TIMESTAMP_NTZ column per entry of ``{new column: source column}``.

    ``reference_year`` places two-digit years within the 50 years around it; it
    defaults to the current year.
    """
    year_now = reference_year or datetime.date.today().year
    stages = [_CLEANED, _TIMED, _SPACED, _CLOCK_CUT, _FIELD_LIST, _WORDS, _SHAPED]
    stages += [_roles(day_first), _parts(year_now)]
    if not columns:
        return df
    keep = [quoted(c) for c in df.columns]

    def own(sql: str, place: int, source: str) -> str:
        return sql.replace("__date_", f"__date{place}_").replace("{v}", quoted(source))

    def of_all(stage: Mapping[str, str]) -> list[str]:
        return [
            own(f"{sql} AS __date_{name}", i, source)
            for i, source in enumerate(columns.values())
            for name, sql in stage.items()
        ]

    isos = [f"__date{i}_iso" for i in range(len(columns))]
    step = df.selectExpr(*keep, *of_all(_ISO))
    for stage in stages:  # as many projections for many columns as for one
        step = step.selectExpr(*keep, *isos, *of_all(stage))
    stamps = [own(_STAMP, i, source) for i, source in enumerate(columns.values())]
    return step.selectExpr(*keep, *[f"{sql} AS {quoted(c)}" for sql, c in zip(stamps, columns)])
