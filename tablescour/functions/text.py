"""Text and null functions on canonical string columns; NULL stays NULL."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablescour.functions import patterns

# Letters that carry case: a word for title case is a run of them.
_CASED = r"\p{IsLowercase}\p{IsUppercase}\p{IsTitlecase}"
_RUNS = f"([{_CASED}]+|[^{_CASED}]+)"


def trim(value: Column) -> Column:
    return F.btrim(value, F.lit(patterns.WHITESPACE))


def collapse_spaces(value: Column) -> Column:
    return F.regexp_replace(value, patterns.WHITESPACE_CLASS + "+", " ")


def title_case(value: Column) -> Column:
    """Upper-case every letter that follows a non-letter, lower-case the others.

    Plain letters and blanks take the generated-code path through ``initcap``; other
    text is cut into runs of cased and uncased characters first.
    """
    runs = F.regexp_extract_all(value, F.lit(_RUNS), F.lit(1))
    exact = F.array_join(F.transform(runs, F.initcap), "")
    return F.when(value.rlike("^[A-Za-z ]*$"), F.initcap(value)).otherwise(exact)


def empty_to_null(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


def null_words_to_null(value: Column, words: Sequence[str] = patterns.NULL_WORDS) -> Column:
    wanted = sorted({w.strip().lower() for w in words})
    if not wanted:
        return value
    bare = F.lower(trim(F.coalesce(value, F.lit(""))))
    return F.when(~bare.isin(wanted), value)


def phone_digits(value: Column) -> Column:
    """Keep decimal digits and plus signs only."""
    return F.regexp_replace(value, r"[^\p{Nd}+]", "")


def is_email(value: Column) -> Column:
    return value.rlike(patterns.java(patterns.EMAIL))


def is_integer(value: Column) -> Column:
    return value.rlike(patterns.java(patterns.INTEGER))


def is_float(value: Column) -> Column:
    return value.rlike(patterns.java(patterns.FLOAT))


def is_boolean_word(value: Column) -> Column:
    return F.lower(trim(value)).isin(patterns.BOOLEAN_WORDS)


def is_phone_like(value: Column) -> Column:
    digits = F.length(F.regexp_replace(value, r"\P{Nd}", ""))
    return value.rlike(patterns.java(patterns.PHONE)) & digits.between(7, 15)


def is_formula(value: Column) -> Column:
    return value.rlike(patterns.java(patterns.FORMULA_START)) & ~value.rlike(
        patterns.java(patterns.SIGNED_NUMBER)
    )


def guard_formula(value: Column) -> Column:
    """Prefix text a spreadsheet would run with a single quote."""
    return F.when(is_formula(value), F.concat(F.lit("'"), value)).otherwise(value)


def number(value: Column) -> Column:
    """The value as a double, NULL when it is not a number (overflow included)."""
    cast = F.trim(value).try_cast("double")
    finite = F.when(F.abs(cast) < F.lit(float("inf")), cast)
    return F.when(value.rlike(patterns.DECIMAL_NUMBER), finite).when(
        value.rlike(patterns.INFINITE_NUMBER), cast
    )
