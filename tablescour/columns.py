"""Shared conventions: the row label, the two nulls, and column lookups."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablescour.errors import CleanError

# 0-based position of a row at load time; carried through filters, dropped at sinks.
ROW = "_row"
# Prefix of counting columns that travel beside the data while a report is made.
TALLY = "__tally_"


def quoted(name: str) -> str:
    """The column name as SQL text, dots and blanks included."""
    return "`" + name.replace("`", "``") + "`"


def ref(name: str) -> Column:
    return F.col(quoted(name))


def evaluated_once(value: Column) -> Column:
    """The same value, kept out of reach of predicate pushdown.

    A filter on a derived column is otherwise rewritten in terms of its inputs, at every
    level, which multiplies the work (and the plan) of columns built in several stages.
    Spark moves no filter below a projection that looks at the partition number.
    """
    return F.when(F.spark_partition_id() >= 0, value)


def data_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c != ROW and not c.startswith(TALLY)]


def is_missing(value: Column) -> Column:
    """Both nulls of the canonical model: a real NULL and the empty string."""
    return value.isNull() | (value == F.lit(""))


def is_present(value: Column) -> Column:
    return value.isNotNull() & (value != F.lit(""))


def differs(before: Column, after: Column) -> Column:
    """A changed cell; NULL and the empty string count as the same value."""
    return F.coalesce(before, F.lit("")) != F.coalesce(after, F.lit(""))


def shown(value: Column) -> Column:
    """How reports print a cell: missing values appear as NULL."""
    return F.nullif(value, F.lit(""))


def require_columns(df: DataFrame, names: Iterable[str], what: str) -> None:
    unknown = [n for n in names if n not in df.columns or n == ROW]
    if unknown:
        raise CleanError(
            "unknown_column",
            f"{what}: unknown column(s) {', '.join(unknown)}.",
            columns=unknown,
        )
