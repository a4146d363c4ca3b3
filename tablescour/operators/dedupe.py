"""Exact and key-based deduplication that keeps the first or the last row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablescour.columns import ROW, data_columns, ref, require_columns
from tablescour.errors import CleanError
from tablescour.plans.spec import DedupeConfig

SAMPLES = 5
COPIES = "__copies"


def key_columns(df: DataFrame, config: DedupeConfig) -> list[str]:
    if config.mode == "exact":
        return data_columns(df)
    if not config.columns:
        raise CleanError(
            "invalid_pipeline", "Name the key columns to deduplicate by."
        )
    require_columns(df, config.columns, "Deduplication key")
    return list(dict.fromkeys(config.columns))


def with_copies(df: DataFrame, config: DedupeConfig) -> DataFrame:
    """One row per key, plus ``__copies``: how many rows shared it.

    First the label of each key's row and its copies are counted, by digests of the keys:
    a hash aggregate of small rows, where rows of a hot key (missing keys are equal to each
    other) meet in the map-side combine. Then the kept labels choose the rows, so no whole
    row is sorted by its key or carried through the aggregate.
    """
    keys = key_columns(df, config)
    pick = F.min if config.keep == "first" else F.max
    kept = [pick(ROW).alias(ROW), F.count(F.lit(1)).alias(COPIES)]
    if not [c for c in data_columns(df) if c not in keys]:
        out = df.groupBy(*[ref(k) for k in keys]).agg(*kept)
        return out.select(*[ref(c) for c in df.columns], COPIES)
    chosen = df.select(row_digest(keys).alias("__key"), ROW).groupBy("__key").agg(*kept)
    rows = df.join(chosen.select(ROW, COPIES), ROW)
    return rows.select(*[ref(c) for c in df.columns], COPIES)


def deduplicate(df: DataFrame, config: DedupeConfig) -> DataFrame:
    return with_copies(df, config).drop(COPIES)


def row_digest(columns: list[str]) -> Column:
    """A fixed-size stand-in for the whole row; NULL, "" and cell borders all count."""
    cells = [
        F.coalesce(F.concat(F.length(ref(c)).cast("string"), F.lit(":"), ref(c)), F.lit("n"))
        for c in columns
    ]
    return F.sha2(F.concat(*cells), 256)


def copy_sums() -> list[Column]:
    """The three counts of a report, over rows that carry ``__copies``."""
    n = F.col(COPIES)
    return [
        F.coalesce(F.sum(F.when(n > 1, n)), F.lit(0)).alias("duplicate_rows_involved"),
        F.coalesce(F.sum(n - 1), F.lit(0)).alias("rows_removed"),
        F.count(F.lit(1)).alias("output_rows"),
    ]


def stats(df: DataFrame, config: DedupeConfig) -> DataFrame:
    """One row of counts. Exact mode shuffles a digest per distinct row, not the row."""
    keys = key_columns(df, config)
    by = [row_digest(keys).alias("k")] if config.mode == "exact" else [ref(k) for k in keys]
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias(COPIES)).agg(*copy_sums())


def duplicate_count(df: DataFrame) -> DataFrame:
    """How many rows repeat an earlier row exactly (0 for an empty frame)."""
    return stats(df, DedupeConfig()).select(F.col("rows_removed").alias("duplicate_rows"))


def removed_samples(df: DataFrame, config: DedupeConfig, limit: int = SAMPLES) -> DataFrame:
    """The first removed rows by row label, whole.

    Only key digests and labels are ranked. Of the overall first ``limit`` removed rows,
    each key holds at most the first ``limit`` + 1 of its own rows; that rank filter runs
    before the shuffle. The few rows shown are then looked up by their labels.
    """
    narrow = df.select(row_digest(key_columns(df, config)).alias("__key"), ROW)
    by_key = W.partitionBy("__key").orderBy(ROW)
    head = narrow.withColumn("__rank", F.row_number().over(by_key)).filter(F.col("__rank") <= limit + 1)
    if config.keep == "first":
        removed = head.filter(F.col("__rank") > 1)
    else:
        later = head.withColumn("__next", F.lead(ROW).over(by_key))
        removed = later.filter(F.col("__next").isNotNull())
    shown = removed.select(ROW).orderBy(ROW).limit(limit)
    return df.join(F.broadcast(shown), ROW, "left_semi").orderBy(ROW)
