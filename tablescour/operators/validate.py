"""Validation rules: bad-value flags, one-pass summaries, samples and row dropping."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablescour.columns import ROW, evaluated_once, is_missing, is_present, ref, require_columns, shown
from tablescour.errors import CleanError
from tablescour.functions import patterns, text
from tablescour.functions.dates import with_parsed_dates
from tablescour.plans.spec import Rule

SAMPLES = 5
# Larger sets of allowed values are joined as a table instead of written into the plan.
MOST_LITERALS = 500
MOST_BROADCAST_BYTES = 64 << 20
_checked_patterns: set[str] = set()


def _check_pattern(df: DataFrame, pattern: str) -> None:
    """Python syntax, and whether the JVM can compile it as well."""
    try:
        re.compile(pattern)
    except re.error as error:
        raise CleanError("invalid_regex", f"Cannot read the pattern: {error}") from error
    if pattern in _checked_patterns:
        return
    try:
        # Literals only: the optimizer evaluates this on the driver, no job runs.
        df.sparkSession.range(1).select(F.lit("").rlike(patterns.java_full(pattern))).collect()
    except Exception as error:
        raise CleanError(
            "invalid_regex", f"The JVM cannot compile the pattern: {pattern}"
        ) from error
    _checked_patterns.add(pattern)


def check(df: DataFrame, rules: Sequence[Rule]) -> None:
    require_columns(df, [r.column for r in rules], "Validation rule")
    for rule in rules:
        if rule.rule == "regex":
            _check_pattern(df, rule.pattern)


def _prepared(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Add parsed dates and numbers once per column, however many rules read them."""
    dates = dict.fromkeys((r.reference_year, r.column) for r in rules if r.rule == "date")
    numbers = dict.fromkeys(r.column for r in rules if r.rule == "numeric_range")
    out = df
    for year in dict.fromkeys(y for y, _ in dates):
        out = with_parsed_dates(out, {_date_of(c, year): c for y, c in dates if y == year}, reference_year=year)
    if numbers:
        made = {f"__number_of_{c}": evaluated_once(text.number(ref(c))) for c in numbers}
        out = out.withColumns(made)
    for i, rule in enumerate(rules):
        if _is_joined(rule):
            out = out.join(_listed(df, rule, i), ref(rule.column) == F.col(f"__listed_{i}"), "left")
    return out


def _date_of(column: str, year: int | None) -> str:
    return f"__date_of_{column}" if year is None else f"__date_of_{year}_{column}"


def _is_joined(rule: Rule) -> bool:
    return rule.rule == "allowed_values" and len(rule.values) > MOST_LITERALS


def _listed(df: DataFrame, rule: Rule, number: int) -> DataFrame:
    """The allowed values, each once, as a table; broadcast where the list is small."""
    values = list(dict.fromkeys(str(v) for v in rule.values))
    listed = df.sparkSession.createDataFrame([(v,) for v in values], f"__listed_{number} string")
    return F.broadcast(listed) if sum(map(len, values)) <= MOST_BROADCAST_BYTES else listed


def _bad(rule: Rule, number: int) -> Column:
    value = ref(rule.column)
    if rule.rule == "required":
        return is_missing(value)
    if rule.rule == "email":
        wrong = ~text.is_email(value)
    elif rule.rule == "numeric_range":
        number = ref(f"__number_of_{rule.column}")
        wrong = number.isNull()
        if rule.min is not None:
            wrong = wrong | (number < F.lit(float(rule.min)))
        if rule.max is not None:
            wrong = wrong | (number > F.lit(float(rule.max)))
    elif rule.rule == "string_length":
        size = F.length(value)
        wrong = F.lit(False)
        if rule.min_length is not None:
            wrong = wrong | (size < rule.min_length)
        if rule.max_length is not None:
            wrong = wrong | (size > rule.max_length)
    elif rule.rule == "date":
        wrong = ref(_date_of(rule.column, rule.reference_year)).isNull()
    elif rule.rule == "regex":
        wrong = ~value.rlike(patterns.java_full(rule.pattern))
    elif _is_joined(rule):
        wrong = F.col(f"__listed_{number}").isNull()
    else:
        wrong = ~value.isin([str(v) for v in rule.values])
    return F.coalesce(is_present(value) & wrong, F.lit(False))


def _reason(rule: Rule) -> Column:
    if rule.rule == "numeric_range":
        low = float(rule.min) if rule.min is not None else "-inf"
        high = float(rule.max) if rule.max is not None else "inf"
        return F.when(ref(f"__number_of_{rule.column}").isNull(), "not a number").otherwise(
            f"value out of range [{low}, {high}]"
        )
    if rule.rule == "string_length":
        low = rule.min_length if rule.min_length is not None else 0
        high = rule.max_length if rule.max_length is not None else "∞"
        return F.lit(f"length outside {low}-{high} characters")
    return F.lit(
        {
            "required": "value is empty",
            "email": "not a valid email address",
            "date": "not a parseable date",
            "regex": "does not match the required pattern",
            "allowed_values": "value is not in the allowed set",
        }[rule.rule]
    )


def flagged(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """The frame plus one boolean ``__bad_<i>`` per rule (never NULL)."""
    check(df, rules)
    flags = [_bad(r, i).alias(f"__bad_{i}") for i, r in enumerate(rules)]
    return _prepared(df, rules).select("*", *flags)


def any_bad(rules: Sequence[Rule]) -> Column:
    """True where any rule fails, over :func:`flagged`."""
    out = F.col("__bad_0")
    for i in range(1, len(rules)):
        out = out | F.col(f"__bad_{i}")
    return out


def drop_invalid(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Rows that pass every rule."""
    kept = flagged(df, rules).filter(~any_bad(rules))
    return kept.select(*[ref(c) for c in df.columns])


def summarize(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """One row per rule, all from one aggregate over one pass of the data."""
    sums = flagged(df, rules).agg(
        *[F.count_if(is_present(ref(r.column))).alias(f"n{i}") for i, r in enumerate(rules)],
        *[F.count_if(F.col(f"__bad_{i}")).alias(f"e{i}") for i in range(len(rules))],
    )
    rows = [
        F.struct(
            F.lit(i).alias("rule_no"),
            F.lit(r.column).alias("column"),
            F.lit(r.rule).alias("rule"),
            F.col(f"n{i}").alias("total_values"),
            F.col(f"e{i}").alias("error_count"),
        )
        for i, r in enumerate(rules)
    ]
    errors, total = F.col("error_count"), F.col("total_values")
    return sums.select(F.inline(F.array(*rows))).select(
        "*",
        F.when(total > 0, F.round(errors / total, 4)).otherwise(0.0).alias("error_rate"),
        (errors == 0).alias("passed"),
    )


def failures(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """One row per failed (row, rule): rule_no, column, rule, row (1-based), value, reason."""
    entries = [
        F.when(
            F.col(f"__bad_{i}"),
            F.struct(
                F.lit(i).alias("rule_no"),
                F.lit(r.column).alias("column"),
                F.lit(r.rule).alias("rule"),
                (F.col(ROW) + 1).alias("row"),
                shown(ref(r.column)).alias("value"),
                _reason(r).alias("reason"),
            ),
        )
        for i, r in enumerate(rules)
    ]
    # Most rows pass everything; they leave before the array is built.
    hit = flagged(df, rules).filter(any_bad(rules))
    return hit.select(F.inline(F.array_compact(F.array(*entries))))


def samples(df: DataFrame, rules: Sequence[Rule], limit: int = SAMPLES) -> DataFrame:
    """The first failing rows of each rule.

    The rank filter is pushed below the shuffle, so each task sends at most ``limit``
    rows per rule, however many rows fail it.
    """
    by_rule = W.partitionBy("rule_no").orderBy("row")
    ranked = failures(df, rules).withColumn("__rank", F.row_number().over(by_rule))
    return ranked.filter(F.col("__rank") <= limit).drop("__rank")
