"""First rows of a table, in row order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescour.columns import ROW, data_columns, ref

# Default numbers of preview rows and of dry-run rows.
PREVIEW_ROWS = 50
DRY_RUN_ROWS = 200


def head(df: DataFrame, limit: int = PREVIEW_ROWS) -> DataFrame:
    """The first rows by label: a top-k per task and one small merge, no full sort."""
    return df.orderBy(ROW).limit(limit)


def records(rows: DataFrame) -> list[dict]:
    """Rows of an already limited frame as dicts of text or None, in row order."""
    names = data_columns(rows)
    ordered = rows.orderBy(ROW) if ROW in rows.columns else rows
    return [dict(zip(names, r)) for r in ordered.select(*[ref(c) for c in names]).collect()]


def preview(df: DataFrame, limit: int | None = None, total_rows: int | None = None) -> dict:
    limit = limit or PREVIEW_ROWS
    if total_rows is None:
        total_rows = df.select(F.lit(1)).count()
    return {
        "columns": data_columns(df),
        "rows": records(head(df, limit)),
        "total_rows": total_rows,
        "limited": total_rows > limit,
    }
