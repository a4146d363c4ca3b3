"""Contiguous row labels without a global sort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablescour.columns import ROW, ref

# Labels per bucket; labels are unique positions, so no bucket holds more rows than this.
BUCKET = 1 << 20


def renumber(df: DataFrame, leading: Sequence[str] = ()) -> DataFrame:
    """Relabel rows 0, 1, 2, … in the order of (leading columns, old label).

    Old labels are cut into fixed ranges. Ranges are counted (one row per million
    labels), their running total gives each range its first new label, and ranks inside
    a range run in parallel. ``leading`` columns are small integers and are dropped.
    """
    by = [*leading, "__bucket"]
    cut = df.withColumn("__bucket", F.floor(F.col(ROW) / BUCKET))
    sizes = cut.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"))
    so_far = W.orderBy(*by).rowsBetween(W.unboundedPreceding, W.currentRow)
    starts = sizes.select(*by, (F.sum("__n").over(so_far) - F.col("__n")).alias("__start"))
    inside = W.partitionBy(*by).orderBy(ROW)
    ranked = cut.withColumn("__rank", F.row_number().over(inside)).join(starts, by)
    label = (F.col("__start") + F.col("__rank") - 1).alias(ROW)
    keep = [label if c == ROW else ref(c) for c in df.columns if c not in leading]
    return ranked.select(*keep)
