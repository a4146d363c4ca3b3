import pytest
from pyspark.sql import functions as F

from tablescour.columns import ROW, data_columns
from tablescour.errors import CleanError
from tablescour.functions import text
from tablescour.functions.canonical import to_canonical
from tablescour.operators import dedupe, mapping, merge, normalize, profile, rows, validate
from tablescour.operators.preview import preview, records
from tablescour.plans.spec import DedupeConfig, NormalizeConfig, RenameConfig, Rule


def code_of(call):
    with pytest.raises(CleanError) as error:
        call()
    return error.value.code


def column(df, name):
    return [r[name] for r in df.orderBy(ROW).collect()]


def one_op(table, op, values, **options):
    config = NormalizeConfig.parse({"columns": [{"column": "a", "operations": [op]}], **options})
    df = table(a=values)
    changed = {r["operation"]: r["changed"] for r in normalize.change_counts(df, config).collect()}
    return column(normalize.normalize(df, config), "a"), changed


ODD = ["  Jo  ", "a\tb　c", "\x1cx\x85", "ÉCOLE straße", "o'brien 3rd ǆ", "中a", None, "", "ΑΣ x", "İ"]


@pytest.mark.parametrize(
    "op, python",
    [
        ("trim", str.strip),
        ("lowercase", str.lower),
        ("uppercase", str.upper),
        ("title_case", str.title),
        ("collapse_spaces", lambda s: __import__("re").sub(r"\s+", " ", s)),
        ("normalize_phone", lambda s: __import__("re").sub(r"[^\d+]", "", s)),
    ],
)
def test_text_operations_follow_python(table, op, python):
    values = [*ODD, "+1 (555) 010-1234", "٣4+", "john o'brien", "MARY-jane", "Jo   hn"]
    got, _ = one_op(table, op, values)
    assert got == [None if v is None else python(v) for v in values]


def test_null_operations(table):
    got, changed = one_op(table, "null_tokens_to_null", ["x", "N/A", " NULL ", "none", "y", "", None])
    assert got == ["x", None, None, None, "y", "", None] and changed == {"null_tokens_to_null": 3}
    got, changed = one_op(table, "empty_to_null", ["", " ", None])
    assert got == [None, " ", None] and changed == {"no_changes": 3}
    assert one_op(table, "null_tokens_to_null", ["", "?"], null_tokens=["", " ? "])[0] == [None, None]


def test_dates_are_rewritten_or_kept(table):
    got, changed = one_op(table, "normalize_date", ["2025-01-15", "01/20/2025", "Jan 25, 2025", "soon", ""])
    assert got == ["2025-01-15", "2025-01-20", "2025-01-25", "soon", ""]
    assert changed == {"normalize_date": 2}
    assert one_op(table, "normalize_date", ["05/03/2025"], day_first=True)[0] == ["2025-03-05"]


def test_counts_and_samples_of_changes(table):
    df = table(a=[" x", "y", None], b=["P ", "q", ""])
    config = NormalizeConfig.parse(
        {"columns": [{"column": "b", "operations": ["trim", "lowercase", "trim"]}, {"column": "a", "operations": ["trim"]}]}
    )
    counts = {(r["column"], r["operation"]): r["changed"] for r in normalize.change_counts(df, config).collect()}
    assert counts == {("b", "trim"): 1, ("b", "lowercase"): 1, ("a", "trim"): 1}
    got = [tuple(r) for r in normalize.change_samples(df, config).collect()]
    assert got == [(1, "a", " x", "x"), (1, "b", "P ", "p")]


def test_normalize_errors(table):
    df = table(a=["x"])
    ops = lambda *names, **more: NormalizeConfig.parse(
        {"columns": [{"column": n, "operations": ["normalize_date"]} for n in names], **more}
    )
    assert code_of(lambda: normalize.normalize(df, ops("b"))) == "unknown_column"
    assert code_of(lambda: normalize.normalize(df, ops("a", "a"))) == "duplicate_column_operation"
    assert code_of(lambda: normalize.normalize(df, ops("a", date_format="%Q"))) == "invalid_date_format"


@pytest.fixture
def checked(table):
    return table(
        mail=["kim@lab.io", "no at sign", "", "lee+1@b-c.co.uk", "z@z.zz"],
        age=["0", "121", "", "old", "64.5"],
        status=["new", "used", "new", "lost", "used"],
        code=["QZ07", "LM4", "q", "", "RS88"],
        joined=["1999-12-31", "03/04/2020", "never", "", "Feb 3, 2021"],
    )


RULES = [
    Rule("mail", "email"),
    Rule("mail", "required"),
    Rule("age", "numeric_range", min=0, max=120),
    Rule("code", "string_length", max_length=3),
    Rule("code", "regex", pattern=r"(?P<two>[A-Z]{2})\d{2}"),
    Rule("status", "allowed_values", values=["new", "used"]),
    Rule("joined", "date"),
]


def test_rules(checked):
    found = {r["rule"]: r for r in validate.summarize(checked, RULES).collect()}
    assert {k: r["error_count"] for k, r in found.items()} == {
        "email": 1, "required": 1, "numeric_range": 2, "string_length": 2, "regex": 2,
        "allowed_values": 1, "date": 1,
    }
    assert found["email"]["total_values"] == 4 and found["email"]["error_rate"] == 0.25
    kept = validate.drop_invalid(checked, [RULES[0], RULES[2]])
    assert [r[ROW] for r in kept.orderBy(ROW).collect()] == [0, 2, 4]


@pytest.mark.parametrize(
    "value, good",
    [(" 12 ", True), ("1e5", True), ("+5", True), ("5.", True), (".5", True), ("inf", True),
     ("-Infinity", True), ("1_000", False), ("1,000", False), ("$5", False), ("0x1A", False),
     ("1d", False), ("1f", False), ("nan", False), ("1e400", False), ("1 2", False)],
)
def test_numbers(table, value, good):
    rule = Rule("a", "numeric_range", min=-1e999)
    assert validate.drop_invalid(table(a=[value]), [rule]).count() == int(good)


def test_rule_details(table):
    df = table(a=["x@y.co\n", "٣", "ab\n", "😀😀"])
    bad = lambda rule: [r["row"] for r in validate.failures(df, [rule]).orderBy("row").collect()]
    assert bad(Rule("a", "email")) == [2, 3, 4]  # one final line break is accepted
    assert bad(Rule("a", "regex", pattern=r"\d")) == [1, 3, 4]
    assert bad(Rule("a", "regex", pattern="ab")) == [1, 2, 3, 4]  # full match
    assert bad(Rule("a", "string_length", max_length=2)) == [1, 3]


def test_samples_are_the_first_rows(spark):
    df = spark.range(0, 1000, 1, 7).selectExpr("id AS _row", "if(id % 3 = 0, '', 'x') AS a")
    got = validate.samples(df, [Rule("a", "required")])
    assert sorted(r["row"] for r in got.collect()) == [1, 4, 7, 10, 13]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan  # the rank is cut before the shuffle


def test_rule_errors(table):
    df = table(a=["x"])
    for rule, code in [
        (Rule("b", "required"), "unknown_column"),
        (Rule("a", "regex", pattern="("), "invalid_regex"),
        (Rule("a", "regex", pattern="(?(1)a|b)(c)"), "invalid_regex"),
    ]:
        assert code_of(lambda: validate.summarize(df, [rule])) == code
    for bad in [
        dict(rule="numeric_range"), dict(rule="string_length"), dict(rule="regex"),
        dict(rule="allowed_values", values=[]), dict(rule="numeric_range", min=2, max=1), dict(rule="odd"),
    ]:
        assert code_of(lambda: Rule("a", **bad)) == "invalid_validation_rule"


@pytest.mark.parametrize("keep, names", [("first", ["A", "B", "C"]), ("last", ["A", "C", "B"])])
@pytest.mark.parametrize("mode, keys", [("exact", []), ("columns", ["mail"])])
def test_dedupe(table, keep, names, mode, keys):
    df = table(mail=list("abacb"), name=list("ABACB"))
    config = DedupeConfig(mode, keys, keep)
    assert column(dedupe.deduplicate(df, config), "name") == names
    assert dedupe.stats(df, config).first().asDict() == {
        "duplicate_rows_involved": 4, "rows_removed": 2, "output_rows": 3,
    }
    removed = [r["mail"] for r in dedupe.removed_samples(df, config).collect()]
    assert removed == (["a", "b"] if keep == "last" else ["a", "b"])


def test_missing_keys_are_equal_and_nulls_differ_from_blanks(table):
    df = table(k=[None, None, "", "", "x"], v=list("abcde"))
    assert column(dedupe.deduplicate(df, DedupeConfig("columns", ["k"])), "v") == ["a", "c", "e"]
    assert dedupe.duplicate_count(table(a=["", None, "x"], b=["x", "x", ""])).first()[0] == 0
    assert dedupe.duplicate_count(table(a=[None, None], b=["", ""])).first()[0] == 1


def test_hot_key_against_brute_force(spark):
    df = spark.range(0, 5000, 1, 9).selectExpr(
        "id AS _row", "if(id % 3 = 0, null, cast(id * 31 % 97 AS string)) AS k", "cast(id AS string) AS v"
    )
    rows_in = [r.asDict() for r in df.orderBy(ROW).collect()]
    for keep in ("first", "last"):
        best = {}
        for r in rows_in if keep == "last" else reversed(rows_in):
            best[r["k"]] = r["v"]
        config = DedupeConfig("columns", ["k"], keep)
        assert {r["k"]: r["v"] for r in dedupe.deduplicate(df, config).collect()} == best
        removed = [r["v"] for r in rows_in if best[r["k"]] != r["v"]][:5]
        assert [r["v"] for r in dedupe.removed_samples(df, config).collect()] == removed


def test_dedupe_errors(table):
    df = table(a=["x"])
    assert code_of(lambda: dedupe.deduplicate(df, DedupeConfig("columns", []))) == "invalid_pipeline"
    assert code_of(lambda: dedupe.deduplicate(df, DedupeConfig("columns", ["b"]))) == "unknown_column"


def test_mapping(table):
    df = table(a=["1"], b=["2"], c=["3"])
    swapped = mapping.map_columns(df, RenameConfig({"a": "b", "b": "a"}, ["c"], ["a", "b"]))
    assert records(swapped) == [{"a": "2", "b": "1"}]
    for config, code in [
        (RenameConfig({"x": "y"}), "unknown_column"),
        (RenameConfig(drop=["x"]), "unknown_column"),
        (RenameConfig({"a": "b"}), "column_name_conflict"),
        (RenameConfig({"a": "z", "b": "z"}), "column_name_conflict"),
        (RenameConfig(order=["a", "b"]), "invalid_column_order"),
    ]:
        assert code_of(lambda: mapping.map_columns(df, config)) == code
    quirk = RenameConfig({"a": "z"}, ["a"])
    assert data_columns(mapping.map_columns(df, quirk)) == ["z", "b", "c"]
    assert mapping.mapping_stats(df, quirk)["stats"]["drop_ignored"] == ["a"]


def test_merge(table):
    one = merge.MergeInput("one", table(cust_nm=["A", "B"], mail=["a", "b"], city=["x", "y"]))
    two = merge.MergeInput("two", table(cust_nm=["C"], mail=["c"], region=["r"]))
    union = merge.merge([one, two])
    assert data_columns(union) == ["cust_nm", "mail", "city", "region"]
    assert column(union, "city") == ["x", "y", None] and column(union, ROW) == [0, 1, 2]
    assert sum(r["null_cells_filled"] for r in merge.merge_stats([one, two]).collect()) == 3
    assert data_columns(merge.merge([one, two], "intersection")) == ["cust_nm", "mail"]
    odd = merge.MergeInput("odd", table(q=["1"]))
    assert code_of(lambda: merge.merge([one, odd], "intersection")) == "no_common_columns"
    assert code_of(lambda: merge.merge([one, two], "outer")) == "invalid_merge_mode"
    wrong = merge.MergeInput("w", one.df, {"nope": "x"})
    assert code_of(lambda: merge.merge([one, wrong])) == "unknown_column"


def test_renumber_closes_gaps(spark):
    df = spark.range(0, 5000, 1, 6).selectExpr("id * 701 AS _row", "cast(id AS string) AS v")
    got = rows.renumber(df.filter("v % 3 <> 1"))
    kept = [v for v in range(5000) if v % 3 != 1]
    assert [(r[ROW], int(r["v"])) for r in got.orderBy(ROW).collect()] == list(enumerate(kept))


@pytest.mark.parametrize(
    "values, kind",
    [
        (["1", "2", "-30", ""], "integer"),
        ([*"123456789", "x"], "integer"),
        (["1.5", "2", ".5", "1e5"], "float"),
        (["yes", "NO", " true "], "boolean"),
        (["2025-01-15", "01/20/2025", "Jan 25, 2025"], "date"),
        (["2025-01-15 10:30", "2025-01-16"], "datetime"),
        (["a@x.com", "b@x.org", "c@x.net", "broken"], "email"),
        (["+1 (555) 010-1234", "555.010.5678 ", "555/010/2222"], "phone"),
        (["a@x.com", "555-1234", "hello"], "string"),
        (["", None, "  "], "empty"),
        (["x" * 300, "y" * 300], "string"),
        (["1" * 200, "2"], "integer"),
    ],
)
def test_detected_types(table, values, kind):
    assert profile.profile(table(a=values)).first()["detected_type"] == kind


def test_profile(table):
    long = "long " * 60
    df = table(
        name=["Ann", "Bob", "Ann", "", None],
        mail=["a@x.com", "b@x.com", "c@x.com", "broken", "d@x.com"],
        body=[long, " ", "z", long, long + "!"],
    )
    name, mail, body = profile.profile(df).orderBy("pos").collect()
    assert (name["null_count"], name["unique_count"], name["sample_values"]) == (2, 2, ["Ann", "Bob"])
    assert (mail["detected_type"], mail["invalid_count"]) == ("email", 1)
    assert (body["unique_count"], body["sample_values"]) == (4, [long, " ", "z"])
    empty = profile.profile(df.filter("false")).orderBy("pos").collect()
    assert [(r["detected_type"], r["row_count"], r["sample_values"]) for r in empty] == [("empty", 0, [])] * 3


def test_canonical_text(spark):
    df = spark.sql("""SELECT * FROM VALUES
        (1863.84D, true, timestamp_ntz'2025-01-02', 12L),
        (12345678.9D, false, timestamp_ntz'2025-01-02 03:04:05.678', null),
        (5.0D, null, null, 0L), (1e-5D, true, null, 1L), (0.00012D, true, null, 1L),
        (1e15D, true, null, 1L), (1.5e17D, true, null, 1L), (1e22D, true, null, 1L),
        (-0.0D, true, null, 1L), (cast('nan' AS double), true, null, 1L),
        (cast('-inf' AS double), true, null, 1L), (123456789012.25D, true, null, 1L) AS t(f, b, t, n)""")
    rows = to_canonical(df).collect()
    wanted = [1863.84, 12345678.9, 5, 1e-5, 0.00012, 1e15, 1.5e17, 1e22, 0, "", "-inf", 123456789012.25]
    assert [r["f"] for r in rows] == [str(w) for w in wanted]
    assert [r["b"] for r in rows[:3]] == ["True", "False", ""]
    assert [r["t"] for r in rows[:3]] == ["2025-01-02", "2025-01-02 03:04:05", ""]
    assert [r["n"] for r in rows[:3]] == ["12", "", "0"]


@pytest.mark.parametrize(
    "value, danger",
    [("=SUM(A1)", True), ("+CMD|x", True), ("-2+3", True), ("@x", True), ("\tx", True), ("\rx", True),
     ("-5", False), ("+3.5", False), ("5", False), ("a=b", False), ("", False), ("'=x", False)],
)
def test_formula_guard(spark, value, danger):
    row = spark.createDataFrame([(value,)], "v string").select(text.guard_formula(F.col("v"))).first()
    assert row[0] == ("'" + value if danger else value)


def test_preview(spark):
    df = spark.range(300).selectExpr("id AS _row", "cast(id AS string) AS v")
    shown = preview(df, 999)
    assert (len(shown["rows"]), shown["total_rows"], shown["limited"]) == (300, 300, False)
    shown = preview(df, 200)
    assert (len(shown["rows"]), shown["total_rows"], shown["limited"]) == (200, 300, True)
    assert preview(df)["rows"][49] == {"v": "49"}
