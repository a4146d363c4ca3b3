"""CSV and JSON output with the spreadsheet formula guard."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tablescour.columns import ROW, data_columns, ref
from tablescour.errors import CleanError
from tablescour.functions.text import guard_formula, is_formula

FORMATS = ("csv", "json")

# The writer trims cells and marks empty ones with quotes unless told otherwise.
_CSV_OPTIONS = {
    "header": True,
    "nullValue": "",
    "emptyValue": "",
    "quote": '"',
    "escape": '"',
    "lineSep": "\n",
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}


def guard(df: DataFrame) -> DataFrame:
    """Every cell that a spreadsheet would run, with a leading quote."""
    return df.select(
        *[ref(c) if c == ROW else guard_formula(ref(c)).alias(c) for c in df.columns]
    )


def guarded_cells(df: DataFrame) -> DataFrame:
    """One row: how many cells the guard changes."""
    flags = [F.count_if(is_formula(ref(c))) for c in data_columns(df)]
    return df.agg(sum(flags[1:], flags[0]).alias("formula_cells_sanitized"))


def _size_of(df: DataFrame, path: str) -> int:
    jvm = df.sparkSession._jvm
    conf = df.sparkSession._jsparkSession.sessionState().newHadoopConf()
    folder = jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(conf).getContentSummary(folder).getLength()


def export(
    df: DataFrame,
    file_format: str,
    path: str,
    guard_formulas: bool = True,
    ordered: bool = False,
) -> dict:
    """Write a folder of part files and return the export stats.

    Counts come from an observation at the top of the written plan: its tasks belong to
    the job's result stage, where a retried task counts once. ``ordered`` range-sorts
    by row label first, so that part files follow each other in row order.
    """
    if file_format not in FORMATS:
        raise CleanError("unsupported_export_format", f"Unsupported export format '{file_format}'.")
    names = data_columns(df)
    out = df.orderBy(ROW) if ordered else df
    guarding = guard_formulas and file_format == "csv"
    flags = [F.coalesce(is_formula(ref(c)).cast("int"), F.lit(0)) for c in names]
    hits = sum(flags[1:], flags[0]) if guarding else F.lit(0)
    cells = [(guard_formula(ref(c)) if guarding else ref(c)).alias(c) for c in names]
    seen = Observation()
    out = out.select(*cells, hits.alias("__hits")).observe(
        seen, F.count(F.lit(1)).alias("rows"), F.sum("__hits").alias("hits")
    )
    out = out.drop("__hits")
    options = dict(_CSV_OPTIONS)
    if file_format == "csv" and len(names) == 1:
        # an empty cell alone in its row would be a blank line, which readers skip
        out = out.select(F.coalesce(ref(names[0]), F.lit("")).alias(names[0]))
        options["emptyValue"] = '""'
    try:
        if file_format == "csv":
            out.write.mode("overwrite").options(**options).csv(path)
        else:
            out.write.mode("overwrite").json(path, ignoreNullFields=False)
    except Exception as error:
        raise CleanError("export_failure", f"Could not write '{path}': {error}") from error
    return {
        "format": file_format,
        "rows": seen.get["rows"],
        "columns": len(names),
        "size_bytes": _size_of(df, path),
        "formula_cells_sanitized": seen.get["hits"] or 0,
    }
