"""Typed tables to the canonical all-string form."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescour.columns import ROW, data_columns, ref

_FRACTIONAL = (T.DoubleType, T.FloatType)
_STAMPS = (T.TimestampType, T.TimestampNTZType)
_NESTED = (T.ArrayType, T.MapType, T.StructType, T.VariantType)


def _float_text(value: Column) -> Column:
    """Whole numbers without a fraction part, others the way Python prints a float.

    Spark switches to exponents at 1e7 and below 1e-3, Python at 1e16 and below 1e-4.
    """
    java_text = value.cast("string")
    size = F.abs(value)
    whole = value == F.floor(value)
    # Rebuild from the shortest digits, so that no binary noise enters.
    shortest = F.regexp_replace(java_text.try_cast("decimal(38,20)").cast("string"), "0+$", "")
    shortest = F.when(shortest.endswith("."), F.concat(shortest, F.lit("0"))).otherwise(shortest)
    mantissa = F.regexp_replace(F.substring_index(java_text, "E", 1), r"\.0$", "")
    power = F.substring_index(java_text, "E", -1).try_cast("int")
    exponent = F.concat(
        F.when(power < 0, "e-").otherwise("e+"),
        F.when(F.abs(power) < 10, F.concat(F.lit("0"), F.abs(power).cast("string"))).otherwise(
            F.abs(power).cast("string")
        ),
    )
    return (
        F.when(F.isnan(value), "")
        .when(size == F.lit(float("inf")), F.when(value > 0, "inf").otherwise("-inf"))
        .when(whole & (size < 1e15), value.cast("bigint").cast("string"))
        .when(~java_text.contains("E"), java_text)
        .when((size >= 1e-4) & (size < 1e16), shortest)
        .otherwise(F.concat(mantissa, exponent))
    )


def _stamp_text(value: Column) -> Column:
    """Seconds resolution; the clock is dropped at midnight."""
    seconds = F.substring(value.cast("string"), 1, 19)
    return F.when(seconds.endswith(" 00:00:00"), F.substring(seconds, 1, 10)).otherwise(seconds)


def canonical_text(value: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.StringType):
        out = value
    elif isinstance(dtype, _STAMPS):
        out = _stamp_text(value)
    elif isinstance(dtype, T.BooleanType):
        out = F.when(value, "True").when(~value, "False")
    elif isinstance(dtype, _FRACTIONAL):
        out = _float_text(value)
    elif isinstance(dtype, _NESTED):
        out = F.to_json(value)
    elif isinstance(dtype, T.BinaryType):
        out = F.hex(value)
    else:
        out = value.cast("string")
    return F.coalesce(out, F.lit(""))


def to_canonical(df: DataFrame, keep: Sequence[str] = (ROW,)) -> DataFrame:
    """Every data column as text, nulls as the empty string; ``keep`` passes through."""
    types = {f.name: f.dataType for f in df.schema.fields}
    passed = [c for c in df.columns if c in keep]
    return df.select(
        *[ref(c) for c in passed],
        *[canonical_text(ref(c), types[c]).alias(c) for c in data_columns(df) if c not in passed],
    )
