"""Cleaning steps on a stream."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescour.columns import ROW, TALLY, data_columns, ref
from tablescour.errors import CleanError
from tablescour.operators.dedupe import key_columns
from tablescour.plans.cleaning import CleaningPlan
from tablescour.plans.spec import DedupeConfig

# The event time while it travels beside the data.
TIME = f"{TALLY}event_time"


def clean_stream(
    stream: DataFrame,
    steps: Any,
    event_time: str | None = None,
    lateness: str = "1 hour",
    horizon: str = "1 day",
) -> DataFrame:
    """The stream with the steps applied; the same plan serves batches.

    Normalize, validate (dropping) and rename steps are projections and filters. A dedupe
    step needs the timestamp column ``event_time`` and keeps state for each key: rows of a
    key belong together while the next one follows within ``horizon``, and the kept one of
    them is sent once no row up to ``lateness`` late can join them. So the first or last
    row by label is kept, whatever order rows arrive in; rows that are later than that are
    dropped, and state goes when its rows are sent. Where all rows of a key lie within
    reach of each other the result is that of the batch.
    """
    plan = CleaningPlan(steps)
    if event_time is None:
        for step in plan.enabled:
            if step.type == "dedupe":
                raise CleanError("invalid_pipeline", "A dedupe step on a stream needs 'event_time'.", step_id=step.id)
        return plan.apply(stream)
    out = stream.withColumnRenamed(event_time, TIME).withWatermark(TIME, lateness)
    for step in plan.enabled:
        if step.type == "dedupe":
            out = _deduplicated(out, step.config, horizon)
        else:
            out = CleaningPlan([step]).apply(out)
    return out.withColumnRenamed(TIME, event_time)


def _deduplicated(stream: DataFrame, config: DedupeConfig, horizon: str) -> DataFrame:
    keys = key_columns(stream, config)
    others = [c for c in data_columns(stream) if c not in keys]
    pick = F.min_by if config.keep == "first" else F.max_by
    payload = F.struct(ref(ROW), *[ref(c) for c in others])
    window = F.session_window(F.col(TIME), horizon).alias("__session")
    kept = stream.groupBy(window, *[ref(k) for k in keys]).agg(pick(payload, ROW).alias("__kept"))
    cells = [ref(c) if c in keys else F.col("__kept").getField(c).alias(c) for c in data_columns(stream)]
    # The end of the session's last instant is the event time for what follows.
    return kept.select(F.window_time("__session").alias(TIME), F.col("__kept").getField(ROW).alias(ROW), *cells)
