"""Ordered cleaning steps as one Spark plan, with or without a report."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablescour.columns import TALLY, is_present, ref
from tablescour.errors import CleanError
from tablescour.operators import dedupe, mapping, normalize, preview, validate
from tablescour.plans.spec import Step, ValidateConfig, parse_steps, steps_to_dict
from tablescour.session import remove, shared_dir

REPORTS = ("counts", "full")


def validated(df: DataFrame, config: ValidateConfig) -> DataFrame:
    if config.drop_invalid_rows:
        return validate.drop_invalid(df, config.rules)
    validate.check(df, config.rules)
    return df


_APPLY = {
    "validate": validated,
    "normalize": normalize.normalize,
    "dedupe": dedupe.deduplicate,
    "rename": mapping.map_columns,
}


@dataclass
class PlanResult:
    df: DataFrame
    input_rows: int
    output_rows: int
    changed_cells: int
    steps: list[dict]
    validation_results: list[dict] = field(default_factory=list)
    # Folders that ``df`` reads; see discard().
    staged: list[str] = field(default_factory=list)

    def discard(self) -> None:
        """Remove the staged copies, once ``df`` has been written elsewhere."""
        for path in self.staged:
            remove(self.df.sparkSession, path)
        self.staged.clear()


class CleaningPlan:
    """Steps run in the given order, each on the output of the one before."""

    def __init__(self, steps: Any):
        self.steps: list[Step] = parse_steps(steps)

    def to_dict(self) -> dict:
        return steps_to_dict(self.steps)

    def to_json(self) -> str:
        return json.dumps(self.to_dict(), ensure_ascii=False)

    @classmethod
    def from_json(cls, text: str) -> CleaningPlan:
        return cls(text)

    @property
    def enabled(self) -> list[Step]:
        return [s for s in self.steps if s.enabled]

    def apply(self, df: DataFrame) -> DataFrame:
        """The cleaned frame as one lazy plan: no report, no job."""
        for step in self.enabled:
            df = _apply(step, df)
        return df

    def run(self, df: DataFrame, report: str = "counts") -> PlanResult:
        """The cleaned frame with exact per-step counts; ``full`` adds samples.

        Steps between two dedupes share one aggregate over one pass. A dedupe writes its
        output to the shared folder together with the number of copies of each kept row,
        so its counts and the steps after it read that table. All counts are query
        results, hence unaffected by retried tasks.
        """
        if report not in REPORTS:
            raise CleanError("invalid_pipeline", f"Unknown report '{report}'.")
        self.apply(df)  # names every bad column before any job runs
        made: dict[str, dict] = {}
        staged: list[str] = []
        source = df
        for narrow, closing in _segments(self.enabled):
            inputs, out = {}, source
            for step in narrow:
                inputs[step.id] = out
                out = _apply(step, out)
            counts = _tally(source, narrow)
            for step in narrow:
                made[step.id] = _narrow_report(step, inputs[step.id], counts, report)
            if closing is not None:
                staged.append(shared_dir(df.sparkSession, "deduped"))
                made[closing.id], out = _dedupe_report(closing, out, counts["rows_out"], report, staged[-1])
            source = out
        result = self._result(df, source, made)
        result.staged = staged
        return result

    def dry_run(self, df: DataFrame, rows: int = preview.DRY_RUN_ROWS) -> PlanResult:
        """The same run on the first rows only; nothing is kept."""
        first = preview.head(df, rows).collect()  # at most ``rows`` rows
        small = df.sparkSession.createDataFrame(first, df.schema).coalesce(1)
        return self.run(small, report="full")

    def _result(self, df: DataFrame, out: DataFrame, made: dict[str, dict]) -> PlanResult:
        if made:
            rows = next(iter(made.values()))["input_rows"]
        else:
            rows = df.select(F.lit(1)).count()
        input_rows, changed, results, reports = rows, 0, [], []
        for step in self.steps:
            if not step.enabled:
                reports.append(
                    _report(step, "skipped", "Step is disabled.", rows, rows, {}, [], [])
                )
                continue
            entry = made[step.id]
            results += entry.pop("validation_results", [])
            changed += entry["stats"].get("changed_cells", 0)
            rows = entry["output_rows"]
            reports.append(entry)
        return PlanResult(out, input_rows, rows, changed, reports, results)


def _apply(step: Step, df: DataFrame) -> DataFrame:
    try:
        return _APPLY[step.type](df, step.config)
    except CleanError as error:
        error.details.setdefault("step_id", step.id)
        error.details.setdefault("step_type", step.type)
        raise


def _segments(steps: Sequence[Step]) -> Iterator[tuple[list[Step], Step | None]]:
    """Runs of narrow steps, each with the dedupe that closes it, if any."""
    narrow: list[Step] = []
    for step in steps:
        if step.type == "dedupe":
            yield narrow, step
            narrow = []
        else:
            narrow.append(step)
    if narrow:
        yield narrow, None


def _tally(df: DataFrame, steps: Sequence[Step]) -> dict[str, int]:
    """Counts of a run of narrow steps, from one aggregate over one pass.

    Dropped rows stay in the frame, marked; every counter looks at the mark first.
    """
    alive = f"{TALLY}alive"
    out = df.withColumn(alive, F.lit(True))
    names: dict[str, str] = {}

    def count(frame: DataFrame, flags: dict[str, Column]) -> DataFrame:
        made = {}
        for key, flag in flags.items():
            names[key] = f"{TALLY}{len(names)}"
            made[names[key]] = F.col(alive) & flag
        return frame.withColumns(made)

    for step in steps:
        columns = out.columns
        out = count(out, {f"{step.id}/rows": F.lit(True)})
        if step.type == "normalize":
            staged = normalize.with_stages(out, step.config)
            flags = {
                f"{step.id}/op/{i}": flag
                for i, (_, _, flag) in enumerate(normalize.counters(step.config))
            }
            for i, (_, flag) in enumerate(normalize.cell_changes(step.config)):
                flags[f"{step.id}/cell/{i}"] = flag
            out = count(staged, flags)
        elif step.type == "validate":
            rules = step.config.rules
            flags = {}
            for i, rule in enumerate(rules):
                flags[f"{step.id}/total/{i}"] = is_present(ref(rule.column))
                flags[f"{step.id}/bad/{i}"] = F.col(f"__bad_{i}")
            out = count(validate.flagged(out, rules), flags)
            if step.config.drop_invalid_rows:
                out = out.withColumn(alive, F.col(alive) & ~validate.any_bad(rules))
        else:
            out = mapping.map_columns(out, step.config)
            columns = [c for c in out.columns]
        tallies = [c for c in out.columns if c.startswith(TALLY) and c not in columns]
        out = out.select(*[ref(c) for c in [*columns, *tallies]])
    out = count(out, {"rows_out": F.lit(True)})
    sums = [F.count_if(F.col(column)).alias(column) for column in names.values()]
    row = out.agg(*sums).first()
    return {key: row[column] for key, column in names.items()}


def _report(step, status, summary, rows_in, rows_out, stats, samples, removed) -> dict:
    return {
        "step_id": step.id,
        "step_type": step.type,
        "enabled": step.enabled,
        "status": status,
        "summary": summary,
        "input_rows": rows_in,
        "output_rows": rows_out,
        "stats": stats,
        "samples": samples,
        "removed_rows": removed,
    }


def _narrow_report(step: Step, df: DataFrame, counts: dict[str, int], report: str) -> dict:
    rows = counts[f"{step.id}/rows"]
    full = report == "full"
    if step.type == "rename":
        made = mapping.mapping_stats(df, step.config)
        stats = made["stats"]
        summary = (
            f"{len(stats['renamed'])} column(s) renamed, {len(stats['dropped'])} dropped,"
            f" {len(stats['output_columns'])} column(s) in output."
        )
        return _report(step, "applied", summary, rows, rows, stats, made["samples"], [])
    if step.type == "normalize":
        stats = _normalize_stats(step, rows, counts)
        samples = []
        if full and stats["changed_cells"]:
            samples = [r.asDict() for r in normalize.change_samples(df, step.config).collect()]
        summary = f"{stats['changed_cells']} cell(s) normalized."
        return _report(step, "applied", summary, rows, rows, stats, samples, [])

    results = validation_results(df, step.config, step.id, counts, full)
    errors = sum(r["error_count"] for r in results)
    dropped = rows - counts[_rows_after(step, counts)] if step.config.drop_invalid_rows else 0
    summary = f"{errors} validation error(s) found; no rows removed."
    if step.config.drop_invalid_rows:
        summary = f"{errors} validation error(s); {dropped} invalid row(s) removed."
    stats = {
        "rules": len(step.config.rules),
        "errors_total": errors,
        "rows_dropped": dropped,
        "drop_invalid_rows": step.config.drop_invalid_rows,
    }
    samples = [
        {"row": s["row"], "column": r["column"], "before": s["value"], "after": None}
        for r in results
        for s in r["samples"]
    ][: validate.SAMPLES]
    entry = _report(step, "applied", summary, rows, rows - dropped, stats, samples, [])
    return {**entry, "validation_results": results}


def _rows_after(step: Step, counts: dict[str, int]) -> str:
    """The counter of rows that reach the next step of the same run."""
    row_keys = [k for k in counts if k.endswith("/rows") or k == "rows_out"]
    return row_keys[row_keys.index(f"{step.id}/rows") + 1]


def _normalize_stats(step: Step, rows: int, counts: dict[str, int]) -> dict:
    per_column: dict[str, dict[str, int]] = {}
    for i, (column, op, _) in enumerate(normalize.counters(step.config)):
        per_column.setdefault(column, {})
        n = counts[f"{step.id}/op/{i}"]
        if n:
            per_column[column][op] = n
    cells = sum(counts[f"{step.id}/cell/{i}"] for i in range(len(step.config.columns)))
    quiet = {"no_changes": rows}
    return {"changed_cells": cells, "per_column": {c: n or quiet for c, n in per_column.items()}}


def validation_results(
    df: DataFrame, config: ValidateConfig, name: str, counts: dict[str, int], samples: bool
) -> list[dict]:
    by_rule: dict[int, list[dict]] = {}
    if samples and any(counts[f"{name}/bad/{i}"] for i in range(len(config.rules))):
        # At most five rows per rule.
        for r in sorted(validate.samples(df, config.rules).collect(), key=lambda r: r["row"]):
            entry = {"row": r["row"], "value": r["value"], "reason": r["reason"]}
            by_rule.setdefault(r["rule_no"], []).append(entry)
    out = []
    for i, rule in enumerate(config.rules):
        total, errors = counts[f"{name}/total/{i}"], counts[f"{name}/bad/{i}"]
        out.append(
            {
                "column": rule.column,
                "rule": rule.rule,
                "total_values": total,
                "error_count": errors,
                "error_rate": round(errors / total, 4) if total else 0.0,
                "passed": errors == 0,
                "samples": by_rule.get(i, []),
            }
        )
    return out


def _dedupe_report(step: Step, df: DataFrame, rows: int, report: str, path: str) -> tuple[dict, DataFrame]:
    spark, config = df.sparkSession, step.config
    dedupe.with_copies(df, config).write.parquet(path)
    kept = spark.read.parquet(path)
    counts = kept.agg(*dedupe.copy_sums()).first().asDict()
    stats = {
        "mode": config.mode,
        "key_columns": list(config.columns) if config.mode == "columns" else [],
        "keep": config.keep,
        **counts,
    }
    removed = []
    if report == "full" and counts["rows_removed"]:
        removed = preview.records(dedupe.removed_samples(df, config))
    summary = f"{counts['rows_removed']} duplicate row(s) removed ({config.keep} kept)."
    entry = _report(
        step, "applied", summary, rows, counts["output_rows"], stats, [], removed
    )
    return entry, kept.drop(dedupe.COPIES)


def run_validation(df: DataFrame, config: ValidateConfig) -> tuple[DataFrame, dict]:
    """Stand-alone validation: the (filtered) frame and totals with per-rule results."""
    plan = CleaningPlan([Step("validation", "validate", config)])
    result = plan.run(df, report="full")
    rows = result.validation_results
    errors = sum(r["error_count"] for r in rows)
    return result.df, {
        "total_rows": result.input_rows,
        "error_count_total": errors,
        "rows_dropped": result.input_rows - result.output_rows,
        "passed": errors == 0,
        "rules": rows,
        "output_rows": result.output_rows,
    }
