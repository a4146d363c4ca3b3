"""Frozen Parquet copies of a table, with contiguous row labels.

Rows without labels are staged once with their source (file and block, or sort partition)
and their place in the writing task. A small table of running totals, one row per source
block, gives every row its label while the frozen copy is written; nothing is sorted
globally, and a lost executor cannot change a label. Reading a snapshot is a plain scan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablescour.columns import ROW, data_columns, ref
from tablescour.errors import CleanError
from tablescour.session import remove, shared_dir

# Where a row came from; staged with unlabelled rows and left out of the frozen copy.
FILE, BLOCK, PLACE = "__file", "__block", "__place"
# Raw text of a record that does not fit the columns; such rows are no data.
CORRUPT = "__corrupt"
_ORIGIN = (FILE, BLOCK, PLACE)


def sorted_for_labels(df: DataFrame, order_by: Sequence[str]) -> DataFrame:
    """Range-partition and sort by a key so that labels follow it.

    The other columns break ties, so equal keys spread over partitions as well.
    """
    names = data_columns(df)
    keys = [ref(c) for c in dict.fromkeys([*order_by, *names])]
    ordered = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return ordered.select(
        "*",
        F.lit("").alias(FILE),
        F.spark_partition_id().cast("bigint").alias(BLOCK),
        F.monotonically_increasing_id().alias(PLACE),
    )


def write_snapshot(df: DataFrame, path: str) -> None:
    """Write rows that are labelled, or tagged with their origin."""
    if ROW in df.columns:
        df.write.mode("overwrite").parquet(f"{path}/rows")
        return
    spark = df.sparkSession
    staged = shared_dir(spark, "staged")
    df.write.mode("overwrite").parquet(f"{staged}/rows")
    write_labelled(spark, staged, path)
    remove(spark, staged)


def labelled(spark: SparkSession, staged: str, per_file: bool = False) -> DataFrame:
    """Staged rows with their labels in place of block and place; files keep their name.

    The running totals are written first, so that Spark knows their size and decides by it
    whether to broadcast them. Labels follow each other over all files by name, or with
    ``per_file`` begin anew in each file.
    """
    rows = spark.read.parquet(f"{staged}/rows")
    blocks = rows.groupBy(FILE, BLOCK).agg(
        F.min(PLACE).alias("first_place"), F.count(F.lit(1)).alias("n")
    )
    order = W.partitionBy(FILE).orderBy(BLOCK) if per_file else W.orderBy(FILE, BLOCK)
    so_far = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    starts = blocks.select(
        FILE, BLOCK, (F.sum("n").over(so_far) - F.col("n") - F.col("first_place")).alias("shift")
    )
    starts.write.mode("overwrite").parquet(f"{staged}/starts")
    starts = spark.read.schema(starts.schema).parquet(f"{staged}/starts")
    names = [c for c in rows.columns if c not in _ORIGIN]
    label = (F.col("shift") + F.col(PLACE)).alias(ROW)
    return rows.join(starts, [FILE, BLOCK]).select(label, FILE, *[ref(c) for c in names])


def write_labelled(spark: SparkSession, staged: str, path: str) -> None:
    """Freeze staged rows under ``path``; rows that are no data leave a gap in the labels."""
    rows = labelled(spark, staged).drop(FILE)
    if CORRUPT in rows.columns:
        rows = rows.filter(F.col(CORRUPT).isNull()).drop(CORRUPT)
    rows.write.mode("overwrite").parquet(f"{path}/rows")


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.parquet(f"{path}/rows")
    except AnalysisException as error:
        raise CleanError("dataset_missing", f"No dataset at '{path}'.", path=path) from error


def read_parquet(spark: SparkSession, paths: Sequence[str] | str) -> DataFrame:
    """Parquet files with labels in file order, straight from the scan.

    The reader knows each row's place in its file; the only extra work is counting rows
    per file, which reads no columns.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    rows = spark.read.parquet(*paths)
    if ROW in rows.columns:
        return rows
    file = F.col("_metadata.file_path").alias(FILE)
    sizes = rows.select(file).groupBy(FILE).agg(F.count(F.lit(1)).alias("n"))
    so_far = W.orderBy(FILE).rowsBetween(W.unboundedPreceding, W.currentRow)
    starts = sizes.select(FILE, (F.sum("n").over(so_far) - F.col("n")).alias("start"))
    placed = rows.select(file, F.col("_metadata.row_index").alias(PLACE), *map(ref, rows.columns))
    return placed.join(starts, FILE).select(
        (F.col("start") + F.col(PLACE)).alias(ROW), *[ref(c) for c in rows.columns]
    )
