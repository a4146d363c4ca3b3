import pytest

from tablescour.columns import ROW
from tablescour.functions.dates import with_parsed_dates
from tablescour.operators import profile, validate
from tablescour.operators.preview import preview
from tablescour.plans.spec import NormalizeConfig, Rule
from tablescour.sinks.export import export
from tablescour.sources.ingest import load_csv


def types_of(df):
    return {r["name"]: r["detected_type"] for r in profile.profile(df).collect()}


def test_a_header_may_be_longer_than_the_first_read(spark, tmp_path):
    names = [f"a_rather_long_column_name_{i}" for i in range(3000)]
    (tmp_path / "wide.csv").write_text(",".join(names) + "\n" + ",".join("1" for _ in names) + "\n")
    df = load_csv(spark, str(tmp_path / "wide.csv"), str(tmp_path / "out"))
    assert [c for c in df.columns if c != ROW] == names and df.count() == 1


def test_one_column_keeps_its_empty_cells(spark, table, tmp_path):
    for values in (["x", "", None, "y"], [None, ""]):
        stats = export(table(a=values), "csv", str(tmp_path / f"{len(values)}"))
        back = load_csv(spark, str(tmp_path / f"{len(values)}"), str(tmp_path / f"in{len(values)}"))
        assert stats["rows"] == back.count() == len(values)
        assert sorted(r["a"] for r in back.collect()) == sorted(v or "" for v in values)


def test_dates_count_over_all_values_and_lengths(table):
    days = [f"2024-{1 + i % 12:02d}-{1 + i % 28:02d} {i % 24:02d}:{i % 60:02d}:00" for i in range(500)]
    assert types_of(table(a=days)) == {"a": "datetime"}
    assert types_of(table(a=days[:100] + [f"word {i}" for i in range(400)])) == {"a": "string"}
    assert types_of(table(a=["Jan" + " " * 140 + "25, 2025"])) == {"a": "date"}


def test_specs_and_previews_take_any_size(table):
    columns = [{"column": f"c{i}" * 60, "operations": ["trim"]} for i in range(201)]
    assert len(NormalizeConfig.parse({"columns": columns}).columns) == 201
    assert len(preview(table(a=[str(i) for i in range(300)]), limit=999)["rows"]) == 300
    rule = Rule("a", "regex", pattern="a{1,3}|" + "b" * 300)
    assert validate.drop_invalid(table(a=["aa", "c"]), [rule]).count() == 1


@pytest.mark.parametrize(
    "pattern, good, bad",
    [
        ("[a&&b]+", ["a&b", "a"], ["c"]),
        ("[[a]+", ["[a["], ["b"]),
        ("[^]a]+", ["b["], ["]", "a"]),
        (r"(?P<a_b>x)(?P<ab>y)(?P=a_b)", ["xyx"], ["xyy"]),
        (r"\[x\]", ["[x]"], ["x"]),
    ],
)
def test_classes_and_group_names_mean_the_same(table, pattern, good, bad):
    df = table(a=good + bad)
    kept = validate.drop_invalid(df, [Rule("a", "regex", pattern=pattern)])
    assert sorted(r["a"] for r in kept.collect()) == sorted(good)


def test_date_columns_share_their_projections(table):
    values = {f"c{i}": ["2024-02-03", "March 4, 2021"] for i in range(12)}
    df = with_parsed_dates(table(**values), {f"d{i}": f"c{i}" for i in range(12)})
    row = df.orderBy(ROW).collect()[1]
    assert all(str(row[f"d{i}"]) == "2021-03-04 00:00:00" for i in range(12))
    plan = df._jdf.queryExecution().analyzed().toString()
    assert plan.count("Project") <= 12


def test_two_digit_years_follow_the_spec(table):
    from tablescour.operators import normalize

    raw = {"columns": [{"column": "a", "operations": ["normalize_date"]}]}
    for year, want in ((1950, "1969-03-01"), (2025, "2069-03-01"), (2090, "2069-03-01")):
        config = NormalizeConfig.parse({**raw, "reference_year": year})
        assert normalize.normalize(table(a=["03/01/69"]), config).first()["a"] == want


def test_removed_samples_rank_narrow_rows(table):
    from tablescour.operators import dedupe
    from tablescour.plans.spec import DedupeConfig

    df = table(a=["x", None, "x", "", None, "x"], b=list("pqrstu"))
    for keep, want in (("first", [2, 4, 5]), ("last", [0, 1, 2])):
        got = dedupe.removed_samples(df, DedupeConfig("columns", ["a"], keep))
        assert [r[ROW] for r in got.collect()] == want and got.columns == df.columns
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    window = next(line for line in plan.splitlines() if "Window [" in line)
    assert " b#" not in window


def test_staged_copies_can_be_discarded(table, tmp_path):
    import os

    from tablescour.plans.cleaning import CleaningPlan

    steps = [{"id": "d", "type": "dedupe", "config": {"mode": "columns", "columns": ["a"]}}]
    result = CleaningPlan(steps).run(table(a=["x", "x", "y"]))
    assert result.output_rows == result.df.count() == 2
    folders = [p.removeprefix("file:") for p in result.staged]
    assert folders and all(map(os.path.isdir, folders))
    result.discard()
    assert not result.staged and not any(map(os.path.exists, folders))
