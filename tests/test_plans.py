import pytest

from tablescour.errors import CleanError
from tablescour.plans.cleaning import CleaningPlan, run_validation
from tablescour.plans.spec import ValidateConfig
from tablescour.plans.workspace import Workspace
from tablescour.operators.preview import records

TRIM = {"id": "t", "type": "normalize", "config": {"columns": [{"column": "cust_nm", "operations": ["trim", "title_case"]}]}}
DEDUPE = {"id": "d", "type": "dedupe", "config": {"mode": "exact"}}
DROP = {"id": "v", "type": "validate", "config": {"rules": [{"column": "age", "rule": "numeric_range", "min": 0, "max": 120}], "drop_invalid_rows": True}}
RENAME = {"id": "r", "type": "rename", "config": {"rename": {"cust_nm": "customer_name"}, "drop": ["mail"]}}


@pytest.fixture
def people(table):
    return table(
        cust_nm=["  ann lee ", "ann lee", "bob", "cid"],
        mail=["a@x.com", "a@x.com", "b@x.com", ""],
        age=["30", "30", "abc", "130"],
    )


def test_order_of_steps_matters(people):
    assert CleaningPlan([TRIM, DEDUPE]).apply(people).count() == 3
    assert CleaningPlan([DEDUPE, TRIM]).apply(people).count() == 4


def test_full_report(people):
    result = CleaningPlan([TRIM, DEDUPE, DROP, {**RENAME}]).run(people, report="full")
    assert (result.input_rows, result.output_rows, result.changed_cells) == (4, 1, 4)
    trim, dedupe, drop, rename = result.steps
    assert trim["stats"] == {"changed_cells": 4, "per_column": {"cust_nm": {"trim": 1, "title_case": 4}}}
    assert trim["samples"][0] == {"row": 1, "column": "cust_nm", "before": "  ann lee ", "after": "Ann Lee"}
    assert dedupe["stats"] == {
        "mode": "exact", "key_columns": [], "keep": "first",
        "duplicate_rows_involved": 2, "rows_removed": 1, "output_rows": 3,
    }
    assert dedupe["removed_rows"] == [{"cust_nm": "Ann Lee", "mail": "a@x.com", "age": "30"}]
    assert (dedupe["input_rows"], dedupe["output_rows"]) == (4, 3)
    assert drop["stats"] == {"rules": 1, "errors_total": 2, "rows_dropped": 2, "drop_invalid_rows": True}
    assert (drop["input_rows"], drop["output_rows"]) == (3, 1)
    assert [s["before"] for s in drop["samples"]] == ["abc", "130"]
    reasons = [s["reason"] for s in result.validation_results[0]["samples"]]
    assert reasons == ["not a number", "value out of range [0.0, 120.0]"]
    assert rename["stats"]["output_columns"] == ["customer_name", "age"]
    assert records(result.df) == [{"customer_name": "Ann Lee", "age": "30"}]


def test_disabled_steps_are_reported_as_skipped(people):
    result = CleaningPlan([{**TRIM, "enabled": False}, DEDUPE]).run(people)
    assert [(s["status"], s["input_rows"], s["output_rows"]) for s in result.steps] == [
        ("skipped", 4, 4), ("applied", 4, 4),
    ]


def test_json_round_trip_and_rejections(people):
    plan = CleaningPlan([TRIM, DROP])
    assert CleaningPlan.from_json(plan.to_json()).to_dict() == plan.to_dict()
    for steps, code in [
        ([TRIM, TRIM], "duplicate_pipeline_step"),
        ([{**TRIM, "type": "explode"}], "invalid_pipeline"),
        ([{**TRIM, "note": 1}], "invalid_pipeline"),
        ([], "invalid_pipeline"),
        ([{**DROP, "config": {"rules": [{"column": "a", "rule": "numeric_range"}]}}], "invalid_validation_rule"),
        ([{**TRIM, "config": {"columns": [{"column": "a", "operations": ["shout"]}]}}], "invalid_operation"),
    ]:
        with pytest.raises(CleanError) as error:
            CleaningPlan(steps)
        assert error.value.code == code


def test_column_errors_name_their_step_and_run_no_job(people):
    bad = {**TRIM, "config": {"columns": [{"column": "nope", "operations": ["trim"]}]}}
    with pytest.raises(CleanError) as error:
        CleaningPlan([bad]).run(people)
    assert (error.value.code, error.value.details["step_id"]) == ("unknown_column", "t")


def test_dry_run_takes_the_first_rows(spark):
    df = spark.range(500).selectExpr("id AS _row", "cast(id % 7 AS string) AS k", "'x' AS cust_nm")
    keyed = {"id": "d", "type": "dedupe", "config": {"mode": "columns", "columns": ["k"]}}
    result = CleaningPlan([keyed]).dry_run(df)
    assert (result.input_rows, result.output_rows) == (200, 7)


def test_validation_totals(people):
    config = ValidateConfig.parse(DROP["config"])
    kept, totals = run_validation(people, config)
    assert kept.count() == 2
    assert {k: totals[k] for k in ("total_rows", "error_count_total", "rows_dropped", "passed", "output_rows")} == {
        "total_rows": 4, "error_count_total": 2, "rows_dropped": 2, "passed": False, "output_rows": 2,
    }


def test_workspace_end_to_end(spark, people, tmp_path):
    space = Workspace(spark, str(tmp_path / "space"))
    one = space.load_table(people)
    result = space.transform(one, [TRIM, DEDUPE, RENAME])
    assert result.output_rows == 3
    assert space.transform(one, [TRIM, DEDUPE, RENAME]).output_rows == 3  # from the original
    assert [r["customer_name"] for r in space.preview(one)["rows"]] == ["Ann Lee", "Bob", "Cid"]
    totals = space.validate(one, {**DROP["config"]})
    assert totals["rows_dropped"] == 2 and space.current(one).count() == 1
    two = space.load_table(people)
    merged, stats = space.merge([one, two])
    assert stats["output_rows"] == 5 and stats["null_cells_filled"] == 2 * 1 + 1 * 4
    assert sorted(r["_row"] for r in space.current(merged).collect()) == [0, 1, 2, 3, 4]
    with pytest.raises(CleanError) as error:
        space.merge([one, one])
    assert error.value.code == "duplicate_merge_input"
    report = space.quality_report(one)
    assert (report["total_rows"], report["original_rows"], report["rows_delta"]) == (1, 4, -3)
    assert report["validation"]["summary"]["rows_dropped"] == 2
    run = space.runs.history(one, "transform").first()
    assert [s.id for s in space.restore(run.run_id).steps] == ["t", "d", "r"]
    space.save_plan(one, [TRIM])
    assert [s.id for s in space.saved_plan(one).steps] == ["t"]
    space.clear_plan(one)
    with pytest.raises(CleanError):
        space.saved_plan(one)
    exported = space.export(one, "csv", str(tmp_path / "out"))
    assert exported["rows"] == 1
    states = {r.dataset_id: r.status for r in space.list_datasets().collect()}
    assert states == {one: "transformed", two: "ready", merged: "ready"}
