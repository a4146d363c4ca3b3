"""Rule summaries of a stream, one record in the run log for each micro-batch."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescour.operators import validate
from tablescour.plans.runs import RunLog
from tablescour.plans.spec import Rule

KIND = "validate_stream"


def record_summaries(log: RunLog, dataset_id: str, rules: Sequence[Rule]) -> Callable[[DataFrame, int], None]:
    """What ``foreachBatch`` calls: count the rules' failures and record them once.

    A batch that is run again after a failure finds its record by the dataset and the
    number of the batch, and adds none.
    """

    def record(batch: DataFrame, number: int) -> None:
        run_id = f"{dataset_id}-batch-{number:012d}"
        if log.holds(run_id):
            return
        rows = [r.asDict() for r in validate.summarize(batch, rules).collect()]  # one row per rule
        log.record(dataset_id, KIND, {"batch": number, "rules": rows}, run_id=run_id)

    return record


def total_summary(log: RunLog, dataset_id: str) -> list[dict]:
    """Counts of all batches so far, one entry for each rule in its order."""
    entry = "array<struct<rule_no:int,column:string,rule:string,total_values:bigint,error_count:bigint>>"
    told = log.table().filter((F.col("dataset_id") == dataset_id) & (F.col("kind") == KIND))
    rows = told.select(F.inline(F.from_json(F.get_json_object("summary", "$.rules"), entry)))
    sums = rows.groupBy("rule_no", "column", "rule").agg(
        F.sum("total_values").alias("total_values"), F.sum("error_count").alias("error_count")
    )
    return [r.asDict() for r in sums.orderBy("rule_no").collect()]
