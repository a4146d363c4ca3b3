"""Column profiles and quality metrics from one value histogram.

Every cell becomes (column, value); a map-side combined count per distinct value then
answers nulls, distinct values, first values, type shares and bad values of all columns
in one shuffle. Long values travel as a SHA-256 digest; the few of them that are shown
as samples are looked up again by their row label.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablescour.columns import ROW, data_columns, is_missing, is_present, ref
from tablescour.functions import text
from tablescour.functions.dates import with_parsed_dates
from tablescour.operators.dedupe import duplicate_count

# Shares and sample sizes that decide a detected type.
TYPE_SHARE = 0.90
EMAIL_PHONE_SHARE = 0.70
SAMPLE_VALUES = 3

# Values that are longer with their blanks trimmed and collapsed are grouped by digest. No
# date, phone or boolean word is this long.
LONG = 128

_INT, _FLOAT, _EMAIL = 1, 2, 4


def _bits(value: Column) -> Column:
    return (
        F.when(text.is_integer(value), _INT).otherwise(0)
        + F.when(text.is_float(value), _FLOAT).otherwise(0)
        + F.when(text.is_email(value), _EMAIL).otherwise(0)
    )


def histogram(df: DataFrame) -> DataFrame:
    """Distinct values per column: pos, key, long, cnt, first_row, bits.

    The closing filter is always true; it makes every reader ask for the same columns,
    so that Spark runs the shuffle once and reuses it.
    """
    cells = []
    for position, name in enumerate(data_columns(df)):
        cells += [F.lit(position), ref(name)]
    values = df.select(ROW, F.stack(F.lit(len(cells) // 2), *cells).alias("pos", "value"))
    value = F.col("value")
    solid_length = F.length(text.collapse_spaces(text.trim(value)))
    long = F.when(F.length(value) > LONG, solid_length > LONG).otherwise(False)
    keyed = values.select(ROW, "pos", "value", long.alias("long")).select(
        ROW,
        "pos",
        "long",
        F.when(F.col("long"), F.sha2("value", 256)).otherwise(F.col("value")).alias("key"),
        F.when(F.col("long"), _bits(F.col("value"))).otherwise(0).alias("bits"),
    )
    counted = keyed.groupBy("pos", "key", "long").agg(
        F.count(F.lit(1)).alias("cnt"),
        F.min(ROW).alias("first_row"),
        F.max("bits").alias("bits"),
    )
    present = is_present(F.col("key"))
    solid = present & (F.col("long") | (text.trim(F.col("key")) != ""))
    return (
        counted.filter(_asked_for("cnt", "bits", F.coalesce("first_row", F.lit(0))))
        .withColumn("present", present)
        .withColumn("solid", solid)
    )


def _asked_for(*columns: Column | str) -> Column:
    """A condition that always holds but needs all these numbers, none below zero."""
    out = F.lit(True)
    for column in columns:
        out = out & ((F.col(column) if isinstance(column, str) else column) >= 0)
    return out


def _classified(hist: DataFrame, reference_year: int | None) -> DataFrame:
    """Type predicates per distinct value, each evaluated once however often it occurs."""
    short = F.when(~F.col("long"), F.col("key"))
    staged = with_parsed_dates(hist.withColumn("__short", short), {"stamp": "__short"}, reference_year=reference_year)
    bits = F.when(F.col("long"), F.col("bits")).otherwise(_bits(F.col("key")))
    return staged.select(
        *[c for c in hist.columns if c != "bits"],
        "stamp",
        F.coalesce(bits, F.lit(0)).alias("bits"),
        F.coalesce(text.is_boolean_word(F.col("__short")), F.lit(False)).alias("word"),
        F.coalesce(text.is_phone_like(F.col("__short")), F.lit(False)).alias("phone"),
    )


def _has(bit: int) -> Column:
    return F.col("bits").bitwiseAND(bit) != 0


def _column_sums(classified: DataFrame) -> DataFrame:
    def weight(condition: Column) -> Column:
        return F.sum(F.when(condition, F.col("cnt")).otherwise(0))

    solid, present, stamp = F.col("solid"), F.col("present"), F.col("stamp")
    clock = (F.hour(stamp) != 0) | (F.minute(stamp) != 0) | (F.second(stamp) != 0)
    return classified.groupBy("pos").agg(
        F.sum("cnt").alias("row_count"),
        weight(~present).alias("null_count"),
        F.count_if(present).alias("unique_count"),
        weight(solid).alias("solid"),
        weight(solid & _has(_INT)).alias("ints"),
        weight(solid & _has(_FLOAT)).alias("floats"),
        weight(solid & F.col("word")).alias("words"),
        weight(solid & _has(_EMAIL)).alias("emails"),
        weight(solid & F.col("phone")).alias("phones"),
        weight(present & ~_has(_EMAIL)).alias("bad_emails"),
        weight(present & F.col("stamp").isNull()).alias("bad_dates"),
        F.count_if(solid).alias("values"),
        F.count_if(solid & _has(_INT)).alias("int_values"),
        F.count_if(solid & stamp.isNotNull()).alias("date_values"),
        F.count_if(solid & clock).alias("clock_values"),
    )


def _first_values(hist: DataFrame) -> DataFrame:
    """The earliest distinct values of each column, ``firsts``.

    The rank filter runs before the shuffle. The presence test is written on the count so
    that it stays above the histogram's shuffle, which is then shared.
    """
    seen = hist.filter(F.when(F.col("present"), F.col("cnt")).otherwise(0) > 0)
    order = W.partitionBy("pos").orderBy("first_row")
    ranked = seen.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= SAMPLE_VALUES)
    return ranked.groupBy("pos").agg(F.array_sort(F.collect_list(F.struct("first_row", "key", "long"))).alias("firsts"))


def _sample_values(df: DataFrame, heads: DataFrame) -> DataFrame:
    """Sample texts per column; digests are replaced by the text of their first row."""
    shown = heads.select("pos", F.inline("firsts"))
    short = shown.filter(~F.col("long")).select("pos", "first_row", F.col("key").alias("value"))
    # At most three rows per column, hence safe to broadcast.
    wanted = shown.filter("long").select("pos", "first_row")
    cells = F.array(*[ref(c) for c in data_columns(df)])
    found = df.join(F.broadcast(wanted), F.col(ROW) == F.col("first_row")).select(
        "pos", "first_row", F.get(cells, F.col("pos")).alias("value")
    )
    listed = F.array_sort(F.collect_list(F.struct("first_row", "value")))
    return short.unionByName(found).groupBy("pos").agg(
        F.transform(listed, lambda s: s["value"]).alias("sample_values")
    )


def _detected_type() -> Column:
    total = F.col("solid")

    def share(name: str) -> Column:
        return F.col(name) / total

    dated = (F.col("values") > F.col("int_values")) & (
        F.col("date_values") / F.col("values") >= TYPE_SHARE
    )
    return (
        F.when(F.coalesce(total, F.lit(0)) == 0, "empty")
        .when(share("ints") >= TYPE_SHARE, "integer")
        .when(share("floats") >= TYPE_SHARE, "float")
        .when(share("words") >= TYPE_SHARE, "boolean")
        .when(dated & (F.col("clock_values") > 0), "datetime")
        .when(dated, "date")
        .when(share("emails") >= EMAIL_PHONE_SHARE, "email")
        .when(share("phones") >= EMAIL_PHONE_SHARE, "phone")
        .otherwise("string")
    )


def profile(df: DataFrame, reference_year: int | None = None) -> DataFrame:
    """One row per column: pos, name, detected_type, row_count, null_count,
    unique_count, sample_values, invalid_count (emails and dates only).

    Two-digit years lie within 50 years of ``reference_year``, or of the year of the run.
    """
    hist = histogram(df)
    heads = _first_values(hist)
    names = df.sparkSession.createDataFrame(
        list(enumerate(data_columns(df))), "pos int, name string"
    )
    detected = F.col("detected_type")
    return (
        names.join(_column_sums(_classified(hist, reference_year)), "pos", "left")
        .join(_sample_values(df, heads), "pos", "left")
        .withColumn("detected_type", _detected_type())
        .select(
            "pos",
            "name",
            "detected_type",
            F.coalesce("row_count", F.lit(0)).alias("row_count"),
            F.coalesce("null_count", F.lit(0)).alias("null_count"),
            F.coalesce("unique_count", F.lit(0)).alias("unique_count"),
            F.coalesce("sample_values", F.array().cast("array<string>")).alias("sample_values"),
            F.when(detected == "email", F.col("bad_emails"))
            .when(detected.isin("date", "datetime"), F.col("bad_dates"))
            .alias("invalid_count"),
        )
    )


def null_counts(df: DataFrame) -> DataFrame:
    """One row per column (pos, name, null_count, row_count); no shuffle of the data."""
    names = data_columns(df)
    sums = df.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(is_missing(ref(c))).alias(f"c{i}") for i, c in enumerate(names)],
    )
    rows = [
        F.struct(
            F.lit(i).alias("pos"),
            F.lit(c).alias("name"),
            F.col(f"c{i}").alias("null_count"),
            F.col("n").alias("row_count"),
        )
        for i, c in enumerate(names)
    ]
    return sums.select(F.inline(F.array(*rows)))


def null_share(counts: DataFrame) -> DataFrame:
    """Whole percent of missing cells per column, 0 for an empty table."""
    share = F.round(100 * F.col("null_count") / F.col("row_count")).cast("int")
    return counts.select("pos", "name", F.when(F.col("row_count") > 0, share).otherwise(0).alias("null_pct"))


def quality_metrics(
    df: DataFrame, original: DataFrame | None = None, reference_year: int | None = None
) -> DataFrame:
    """The report's totals as (metric, value) rows."""
    columns = len(data_columns(df))
    bad = F.coalesce(F.col("invalid_count"), F.lit(0))
    sums = profile(df, reference_year).agg(
        F.coalesce(F.max("row_count"), F.lit(0)).alias("total_rows"),
        F.lit(columns).cast("bigint").alias("total_columns"),
        F.coalesce(F.sum("null_count"), F.lit(0)).alias("null_cells_total"),
        F.sum(F.when(F.col("detected_type") == "email", bad).otherwise(0)).alias(
            "invalid_email_count"
        ),
        F.sum(F.when(F.col("detected_type").isin("date", "datetime"), bad).otherwise(0)).alias(
            "invalid_date_count"
        ),
    )
    parts = [sums.unpivot([], sums.columns, "metric", "value")]
    duplicates = duplicate_count(df)
    parts.append(duplicates.unpivot([], duplicates.columns, "metric", "value"))
    if original is not None:
        before = original.agg(F.count(F.lit(1)).alias("original_rows"))
        parts.append(before.unpivot([], before.columns, "metric", "value"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    if original is None:
        return out
    # the difference follows from two of the totals: no third run over the tables
    known = out.agg(F.map_from_entries(F.collect_list(F.struct("metric", "value"))).alias("m"))
    delta = F.create_map(F.lit("rows_delta"), F.col("m")["total_rows"] - F.col("m")["original_rows"])
    return known.select(F.explode(F.map_concat("m", delta)).alias("metric", "value"))
