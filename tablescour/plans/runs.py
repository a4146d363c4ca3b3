"""Run history: an append-only table and the usual questions about it."""

from __future__ import annotations

import datetime
import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablescour.errors import CleanError

SCHEMA = (
    "run_id string, dataset_id string, kind string, status string, "
    "summary string, created_at timestamp"
)


def history(runs: DataFrame, dataset_id: str | None = None, kind: str | None = None) -> DataFrame:
    """Runs, newest first, of one dataset and kind where given."""
    if dataset_id is not None:
        runs = runs.filter(F.col("dataset_id") == dataset_id)
    if kind is not None:
        runs = runs.filter(F.col("kind") == kind)
    return runs.orderBy(F.desc("created_at"), F.desc("run_id"))


def last_per(runs: DataFrame, *keys: str) -> DataFrame:
    """The newest run of each (dataset, kind) or other key: one combining aggregate."""
    payload = F.struct(*[c for c in runs.columns if c not in keys])
    newest = F.max_by(payload, F.struct("created_at", "run_id")).alias("last")
    return runs.groupBy(*keys).agg(newest).select(*keys, "last.*")


def catalog(runs: DataFrame) -> DataFrame:
    """Datasets with their latest state, newest first.

    Loads, merges, transforms and row-dropping validations carry row and column counts
    in their summary; other runs leave the state of a dataset alone.
    """
    state = runs.select(
        "*",
        F.get_json_object("summary", "$.row_count").try_cast("bigint").alias("row_count"),
        F.get_json_object("summary", "$.column_count").try_cast("bigint").alias("column_count"),
        F.get_json_object("summary", "$.path").alias("path"),
    ).filter(F.col("row_count").isNotNull())
    first = runs.groupBy("dataset_id").agg(F.min("created_at").alias("created_at"))
    latest = last_per(state, "dataset_id").select(
        "dataset_id", "kind", "row_count", "column_count", "path", F.col("created_at").alias("updated_at")
    )
    status = F.when(F.col("kind").isin("transform", "validate"), "transformed").otherwise("ready")
    return (
        latest.join(first, "dataset_id")
        .withColumn("status", status)
        .orderBy(F.desc("created_at"), F.desc("dataset_id"))
    )


class RunLog:
    """The ``runs`` table of a workspace; every record is one appended row."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def record(
        self, dataset_id: str, kind: str, summary: dict, status: str = "success", run_id: str | None = None
    ) -> str:
        run_id = run_id or uuid.uuid4().hex
        now = datetime.datetime.now(datetime.timezone.utc)
        row = (run_id, dataset_id, kind, status, json.dumps(summary, ensure_ascii=False), now)
        one = self.spark.createDataFrame([row], SCHEMA).coalesce(1)
        one.write.mode("append").parquet(self.path)
        return run_id

    def table(self) -> DataFrame:
        try:
            return self.spark.read.schema(SCHEMA).parquet(self.path)
        except AnalysisException:
            return self.spark.createDataFrame([], SCHEMA)

    def holds(self, run_id: str) -> bool:
        return not self.table().filter(F.col("run_id") == run_id).isEmpty()

    def history(self, dataset_id: str | None = None, kind: str | None = None) -> DataFrame:
        return history(self.table(), dataset_id, kind)

    def catalog(self) -> DataFrame:
        return catalog(self.table())

    def last(self, dataset_id: str, kind: str) -> dict | None:
        row = self.history(dataset_id, kind).first()
        if row is None:
            return None
        return {"run_id": row.run_id, "at": row.created_at, "summary": json.loads(row.summary)}

    def plan_of(self, run_id: str) -> str:
        """The JSON of the cleaning plan a transform run used."""
        row = (
            self.table()
            .filter(F.col("run_id") == run_id)
            .select(F.get_json_object("summary", "$.pipeline").alias("plan"))
            .first()
        )
        if row is None or row.plan is None:
            raise CleanError("pipeline_not_found", f"Run '{run_id}' holds no cleaning plan.")
        return row.plan
