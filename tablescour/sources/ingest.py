"""Loading files and tables into labelled snapshots, one dataset or a whole batch."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablescour.columns import ROW
from tablescour.errors import CleanError
from tablescour.functions.canonical import to_canonical
from tablescour.session import remove, shared_dir
from tablescour.sources.csvfiles import csv_settings, ragged_records, read_rows, scan
from tablescour.sources.inventory import inventory
from tablescour.sources.snapshots import (
    BLOCK,
    CORRUPT,
    FILE,
    PLACE,
    labelled,
    read_snapshot,
    sorted_for_labels,
    write_labelled,
    write_snapshot,
)


def load_csv(
    spark: SparkSession,
    paths: Sequence[str] | str,
    target: str | None = None,
    on_ragged: str = "reject",
) -> DataFrame:
    """One table from CSV files, frozen under ``target`` and labelled in file order.

    Rows of the wrong width reject the load (``malformed_csv``) before ``target`` is
    touched, or with ``on_ragged="quarantine"`` go to ``<target>/quarantine`` as raw text
    and leave a gap in the labels. The files are parsed once, into a staged copy.
    """
    target = target or shared_dir(spark, "csv")
    staged = shared_dir(spark, "staged")
    with csv_settings(spark):
        read_rows(spark, paths).write.mode("overwrite").parquet(f"{staged}/rows")
    bad = ragged_records(spark.read.parquet(f"{staged}/rows"))
    ragged = bad.count()
    if ragged and on_ragged == "reject":
        remove(spark, staged)
        raise CleanError(
            "malformed_csv", f"{ragged} record(s) have the wrong number of fields.", records=ragged
        )
    remove(spark, f"{target}/quarantine")
    if ragged:
        bad.write.mode("overwrite").parquet(f"{target}/quarantine")
    write_labelled(spark, staged, target)
    remove(spark, staged)
    return read_snapshot(spark, target)


def load_table(df: DataFrame, target: str | None = None, order_by: Sequence[str] = ()) -> DataFrame:
    """A typed table in canonical form, frozen and labelled along ``order_by``.

    A frame that has row labels already keeps them.
    """
    target = target or shared_dir(df.sparkSession, "table")
    if ROW in df.columns:
        write_snapshot(to_canonical(df), target)
    else:
        if not order_by:
            raise CleanError("invalid_pipeline", "Give 'order_by' columns, or a frame with row labels.")
        origin = (FILE, BLOCK, PLACE)
        write_snapshot(to_canonical(sorted_for_labels(df, order_by), keep=origin), target)
    return read_snapshot(df.sparkSession, target)


def ingest_many(spark: SparkSession, paths: Sequence[str] | str, root: str) -> DataFrame:
    """Load many CSV files, each as its own dataset, with one scan per shape of file.

    Files of one delimiter, encoding and width are scanned together, whatever their
    headers say; cells are stored by position below ``<root>/shape-N``, and
    ``<root>/files`` tells each file's shape and names, which apply when it is read.

    Returns one row per file: path, filename, status (uploaded or failed), row_count,
    column_count, size_bytes, error_code and dataset (where its rows are). A file that
    fails does not hold up the others.
    """
    listed = _stored(inventory(spark, paths).withColumn("width", F.size("header")), f"{root}/inventory")
    key = ["delimiter", "encoding", "width", "spans_lines"]
    shapes = (
        listed.filter(F.col("error_code").isNull())
        .groupBy(*key)
        .agg(F.sort_array(F.collect_list("path")).alias("paths"))
        .orderBy(*key)
        .collect()
    )
    places, counts = [], []
    for number, shape in enumerate(shapes):
        staged, folder = shared_dir(spark, "staged"), f"{root}/shape-{number}"
        with csv_settings(spark):
            rows = scan(
                spark,
                shape["paths"],
                [position(i) for i in range(shape["width"])],
                shape["delimiter"],
                shape["encoding"],
                shape["spans_lines"],
            )
            rows.write.mode("overwrite").parquet(f"{staged}/rows")
        labelled(spark, staged, per_file=True).write.mode("overwrite").parquet(f"{folder}/rows")
        remove(spark, staged)
        places.append((*(shape[k] for k in key), folder))
        counts.append(
            spark.read.parquet(f"{folder}/rows")
            .groupBy(F.col(FILE).alias("path"))
            .agg(
                F.count(F.lit(1)).alias("row_count"),
                F.count_if(F.col(CORRUPT).isNotNull()).alias("ragged"),
            )
        )
    seen = reduce(
        DataFrame.unionByName, counts, spark.createDataFrame([], "path string, row_count bigint, ragged bigint")
    )
    datasets = spark.createDataFrame(
        places, "delimiter string, encoding string, width int, spans_lines boolean, folder string"
    )
    code = F.when(F.col("error_code").isNotNull(), F.col("error_code")).when(F.col("ragged") > 0, "malformed_csv")
    joined = listed.join(F.broadcast(datasets), key, "left").join(seen, "path", "left")
    good = F.col("code").isNull()
    files = joined.select("*", code.alias("code")).select(
        "path",
        "filename",
        F.when(good, "uploaded").otherwise("failed").alias("status"),
        F.when(good, F.coalesce("row_count", F.lit(0))).alias("row_count"),
        F.when(good, F.col("width")).alias("column_count"),
        "size_bytes",
        F.col("code").alias("error_code"),
        F.when(good, F.col("folder")).alias("dataset"),
        "header",
    )
    return _stored(files, f"{root}/files").drop("header")


def _stored(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def position(number: int) -> str:
    """Name of a column that is known by its place only."""
    return f"__cell_{number}"


def ingested(spark: SparkSession, dataset: str, path: str) -> DataFrame:
    """The labelled rows of one file that :func:`ingest_many` loaded, under its names."""
    files = spark.read.parquet(f"{dataset.rsplit('/', 1)[0]}/files")
    file = files.filter((F.col("path") == path) & (F.col("dataset") == dataset)).first()
    if file is None:
        raise CleanError("dataset_missing", f"No file '{path}' in '{dataset}'.", path=path)
    rows = spark.read.parquet(f"{dataset}/rows").filter(F.col(FILE) == path)
    return rows.select(ROW, *[F.col(position(i)).alias(name) for i, name in enumerate(file["header"])])
