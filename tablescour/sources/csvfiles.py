"""CSV files to canonical string tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescour.columns import quoted, ref
from tablescour.errors import CleanError
from tablescour.session import settings
from tablescour.sources.inventory import inventory, plain_path
from tablescour.sources.records import spanning_records
from tablescour.sources.snapshots import BLOCK, CORRUPT, FILE, PLACE


def csv_settings(spark: SparkSession):
    """Windows-1252 input, and no pruning, which would hide rows of the wrong width."""
    return settings(
        spark,
        spark__sql__legacy__javaCharsets="true",
        spark__sql__csv__parser__columnPruning__enabled="false",
    )


def scan(
    spark: SparkSession,
    paths: Sequence[str],
    names: Sequence[str],
    delimiter: str = ",",
    encoding: str = "UTF-8",
    spans_lines: bool = False,
) -> DataFrame:
    """Rows of equally shaped files: cells, their origin, and the raw text of bad rows.

    Files are split among tasks; where quoted cells hold line breaks, records are cut out
    first (:mod:`tablescour.sources.records`). Use inside :func:`csv_settings`.
    """
    if CORRUPT in names:
        raise CleanError("malformed_csv", f"'{CORRUPT}' is a reserved column name.")
    options = dict(
        sep=delimiter,
        quote='"',
        escape='"',
        maxCharsPerColumn=-1,
        maxColumns=max(20_480, 2 * len(names)),  # room for records longer than the header
        mode="PERMISSIVE",
        columnNameOfCorruptRecord=CORRUPT,
    )
    if spans_lines:
        return _scan_records(spark, paths, names, delimiter, encoding, options)
    fields = [T.StructField(n, T.StringType()) for n in [*names, CORRUPT]]
    rows = (
        spark.read.schema(T.StructType(fields))
        .options(header=True, enforceSchema=True, encoding=encoding, **options)
        .csv(list(paths))
    )
    return rows.select(
        *[F.coalesce(ref(n), F.lit("")).alias(n) for n in names],
        CORRUPT,
        plain_path(F.col("_metadata.file_path")).alias(FILE),
        F.col("_metadata.file_block_start").alias(BLOCK),
        F.monotonically_increasing_id().alias(PLACE),
    )


def _scan_records(spark, paths, names, delimiter, encoding, options) -> DataFrame:
    """Rows of files whose records span lines; each record is parsed on its own."""
    records = spanning_records(spark, paths, delimiter)
    text = F.col("record").cast("string") if encoding == "UTF-8" else F.decode("record", encoding)
    # By number: names may differ in case only, which fields of a struct may not.
    cells = [f"c{i}" for i in range(len(names))]
    schema = ", ".join(f"{quoted(c)} string" for c in [*cells, CORRUPT])
    options = {k: str(v) for k, v in options.items()} | {"multiLine": "true"}
    parsed = F.from_csv(text, schema, options)
    return records.withColumn("cells", parsed).select(
        *[F.coalesce(F.col("cells").getField(c), F.lit("")).alias(n) for c, n in zip(cells, names)],
        F.col("cells").getField(CORRUPT).alias(CORRUPT),
        plain_path(F.col("path")).alias(FILE),
        F.col("block").alias(BLOCK),
        F.col("place").alias(PLACE),
    )


def ragged_records(rows: DataFrame) -> DataFrame:
    """(path, record): the rows of the wrong width as raw text."""
    return rows.filter(F.col(CORRUPT).isNotNull()).select(
        F.col(FILE).alias("path"), F.col(CORRUPT).alias("record")
    )


def raise_first_failure(listed) -> None:
    for row in listed:
        if row["error_code"]:
            raise CleanError(row["error_code"], f"'{row['path']}' cannot be loaded.", path=row["path"])


def describe_one_layout(spark: SparkSession, paths: Sequence[str] | str) -> dict:
    """Scan options shared by all files of a table; raises the first failure."""
    listed = inventory(spark, paths).orderBy("path").collect()
    if not listed:
        raise CleanError("dataset_missing", f"No file at {paths}.")
    raise_first_failure(listed)
    layouts = {(r["delimiter"], r["encoding"], tuple(r["header"])) for r in listed}
    if len({h for _, _, h in layouts}) > 1:
        raise CleanError("malformed_csv", "The files of one table must share their header.")
    groups: dict[tuple, list[str]] = {}
    for r in listed:
        groups.setdefault((r["delimiter"], r["encoding"], r["spans_lines"]), []).append(r["path"])
    return {"names": listed[0]["header"], "groups": groups}


def read_rows(spark: SparkSession, paths: Sequence[str] | str) -> DataFrame:
    """All rows of one table's CSV files with their origin; see :func:`scan`."""
    layout = describe_one_layout(spark, paths)
    parts = [
        scan(spark, files, layout["names"], delimiter, encoding, spans)
        for (delimiter, encoding, spans), files in layout["groups"].items()
    ]
    out = parts[0]
    for part in parts[1:]:
        # Places are unique per block, and a block belongs to one part only.
        out = out.unionByName(part)
    return out
