"""Datasets on shared storage: load, clean, validate, merge, export and report."""

from __future__ import annotations

import datetime
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablescour.columns import data_columns
from tablescour.errors import CleanError
from tablescour.operators import match, merge, preview, profile
from tablescour.operators.dedupe import duplicate_count
from tablescour.plans.cleaning import CleaningPlan, PlanResult, run_validation
from tablescour.plans.runs import RunLog
from tablescour.plans.spec import ValidateConfig
from tablescour.session import tune
from tablescour.sinks import export as sinks
from tablescour.sources import ingest
from tablescour.sources.snapshots import read_snapshot, write_snapshot


def profile_rows(df: DataFrame) -> list[dict]:
    """The profile as dicts, one per column; the count of bad values only where it applies."""
    out = []
    for row in profile.profile(df).orderBy("pos").collect():
        entry = row.asDict()
        del entry["pos"], entry["row_count"]
        if entry["invalid_count"] is None:
            del entry["invalid_count"]
        out.append(entry)
    return out


class Workspace:
    """Each dataset has an ``original`` snapshot and, after changes, newer versions.

    A change writes a new folder and then one run record that names it; readers follow
    the newest record, so no folder is overwritten while it is read.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = tune(spark), root.rstrip("/")
        self.runs = RunLog(spark, f"{self.root}/runs")

    def _new_path(self, dataset_id: str, name: str) -> str:
        return f"{self.root}/datasets/{dataset_id}/{name}"

    def _state(self, dataset_id: str) -> dict:
        found = self.runs.catalog().filter(F.col("dataset_id") == dataset_id).first()
        if found is None:
            raise CleanError("dataset_missing", f"Unknown dataset '{dataset_id}'.")
        return found.asDict()

    def _register(self, dataset_id: str, kind: str, df: DataFrame, path: str, **more) -> int:
        rows = df.select(F.lit(1)).count()
        state = {"row_count": rows, "column_count": len(data_columns(df)), "path": path}
        self.runs.record(dataset_id, kind, {**more, **state})
        return rows

    def load_csv(self, paths: Sequence[str] | str, on_ragged: str = "reject") -> str:
        dataset_id = uuid.uuid4().hex
        path = self._new_path(dataset_id, "original")
        df = ingest.load_csv(self.spark, paths, path, on_ragged)
        self._register(dataset_id, "upload", df, path)
        return dataset_id

    def load_table(self, df: DataFrame, order_by: Sequence[str] = ()) -> str:
        dataset_id = uuid.uuid4().hex
        path = self._new_path(dataset_id, "original")
        self._register(dataset_id, "upload", ingest.load_table(df, path, order_by), path)
        return dataset_id

    def original(self, dataset_id: str) -> DataFrame:
        return read_snapshot(self.spark, self._new_path(dataset_id, "original"))

    def current(self, dataset_id: str) -> DataFrame:
        return read_snapshot(self.spark, self._state(dataset_id)["path"])

    def list_datasets(self) -> DataFrame:
        return self.runs.catalog()

    def detail(self, dataset_id: str) -> dict:
        state, df = self._state(dataset_id), self.current(dataset_id)
        state["is_transformed"] = state["status"] == "transformed"
        return {**state, "columns": profile_rows(df)}

    def preview(self, dataset_id: str, limit: int | None = None) -> dict:
        state = self._state(dataset_id)
        df = read_snapshot(self.spark, state["path"])
        return preview.preview(df, limit, state["row_count"])

    def transform(self, dataset_id: str, steps, report: str = "counts") -> PlanResult:
        """Clean the original snapshot; the result replaces the current one."""
        plan = CleaningPlan(steps)
        result = plan.run(self.original(dataset_id), report)
        path = self._new_path(dataset_id, f"version-{uuid.uuid4().hex}")
        write_snapshot(result.df, path)
        result.discard()
        result.df = read_snapshot(self.spark, path)
        listed = [
            {"id": s["step_id"], "type": s["step_type"], "status": s["status"], "summary": s["summary"]}
            for s in result.steps
        ]
        self.runs.record(
            dataset_id,
            "transform",
            {
                "input_rows": result.input_rows,
                "output_rows": result.output_rows,
                "changed_cells": result.changed_cells,
                "steps": listed,
                "pipeline": plan.to_dict(),
                "row_count": result.output_rows,
                "column_count": len(data_columns(result.df)),
                "path": path,
            },
        )
        return result

    def dry_run(self, dataset_id: str, steps) -> PlanResult:
        return CleaningPlan(steps).dry_run(self.original(dataset_id))

    def restore(self, run_id: str) -> CleaningPlan:
        """The plan of a past transform, ready to run again."""
        return CleaningPlan.from_json(self.runs.plan_of(run_id))

    def save_plan(self, dataset_id: str, steps) -> None:
        plan = CleaningPlan(steps)
        self._state(dataset_id)
        self.runs.record(dataset_id, "plan", {"pipeline": plan.to_dict()})

    def saved_plan(self, dataset_id: str) -> CleaningPlan:
        last = self.runs.last(dataset_id, "plan")
        if last is None or not last["summary"].get("pipeline"):
            raise CleanError("pipeline_not_found", f"Dataset '{dataset_id}' has no saved plan.")
        return CleaningPlan(last["summary"]["pipeline"])

    def clear_plan(self, dataset_id: str) -> None:
        self.saved_plan(dataset_id)
        self.runs.record(dataset_id, "plan", {"pipeline": None})

    def validate(self, dataset_id: str, config: ValidateConfig | dict) -> dict:
        """Check the current dataset; it changes only if rows are dropped."""
        if not isinstance(config, ValidateConfig):
            config = ValidateConfig.parse(config)
        df = self.current(dataset_id)
        kept, totals = run_validation(df, config)
        summary = {
            "rules": len(config.rules),
            "errors_total": totals["error_count_total"],
            "rows_dropped": totals["rows_dropped"],
            "dropped_rows_applied": totals["rows_dropped"] > 0,
        }
        if totals["rows_dropped"]:
            path = self._new_path(dataset_id, f"version-{uuid.uuid4().hex}")
            write_snapshot(kept, path)
            summary |= {
                "row_count": totals["output_rows"],
                "column_count": len(data_columns(kept)),
                "path": path,
            }
        self.runs.record(dataset_id, "validate", summary)
        return totals

    def merge(
        self,
        dataset_ids: Sequence[str],
        mode: str = "union",
        mappings: Mapping[str, Mapping[str, str]] | None = None,
    ) -> tuple[str, dict]:
        """Stack current datasets into a new one; returns its id and the merge stats."""
        twice = [d for d in dataset_ids if list(dataset_ids).count(d) > 1]
        if twice:
            raise CleanError("duplicate_merge_input", f"Dataset '{twice[0]}' is listed twice.")
        mappings = mappings or {}
        inputs = [
            merge.MergeInput(d, self.current(d), mappings.get(d, {})) for d in dataset_ids
        ]
        merged = merge.merge(inputs, mode)
        dataset_id = uuid.uuid4().hex
        path = self._new_path(dataset_id, "original")
        write_snapshot(merged, path)
        rows = merge.merge_stats(inputs, mode).orderBy("input").collect()
        stats = {
            "mode": mode,
            "input_files": [
                {"dataset_id": r["name"], "rows": r["rows"], "columns": r["columns"]} for r in rows
            ],
            "output_rows": sum(r["rows"] for r in rows),
            "output_columns": len(data_columns(merged)),
            "columns": data_columns(merged),
            "null_cells_filled": sum(r["null_cells_filled"] for r in rows),
        }
        self._register(dataset_id, "merge", read_snapshot(self.spark, path), path, **stats)
        for d in dataset_ids:
            self.runs.record(d, "merge", {"merged_into": dataset_id, "mode": mode})
        return dataset_id, stats

    def export(self, dataset_id: str, file_format: str, path: str, guard: bool = True) -> dict:
        stats = sinks.export(self.current(dataset_id), file_format, path, guard)
        self.runs.record(dataset_id, "export", {"filename": path, **stats})
        return stats

    def suggest_mapping(self, dataset_id: str, targets: Sequence[str] = ()) -> DataFrame:
        return match.suggest_for(self.current(dataset_id), targets)

    def quality_report(self, dataset_id: str) -> dict:
        """Totals, per-column profile and the last runs; driver data is one row per column."""
        df, original = self.current(dataset_id), self.original(dataset_id)
        columns = profile_rows(df)
        total_rows = df.select(F.lit(1)).count()
        original_rows = original.select(F.lit(1)).count()

        def bad(*types: str) -> int:
            return sum(c.get("invalid_count", 0) for c in columns if c["detected_type"] in types)

        report = {
            "dataset_id": dataset_id,
            "generated_at": datetime.datetime.now(datetime.timezone.utc).isoformat(),
            "total_rows": total_rows,
            "total_columns": len(columns),
            "null_counts": {c["name"]: c["null_count"] for c in columns},
            "null_cells_total": sum(c["null_count"] for c in columns),
            "duplicate_rows": duplicate_count(df).first()["duplicate_rows"],
            "invalid_email_count": bad("email"),
            "invalid_date_count": bad("date", "datetime"),
            "columns": columns,
            "original_rows": original_rows,
            "rows_delta": total_rows - original_rows,
        }
        for kind in ("validate", "transform", "merge"):
            report[kind if kind != "validate" else "validation"] = self.runs.last(dataset_id, kind)
        return report
