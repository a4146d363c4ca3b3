"""What the plans of hot operators hold."""

from tablescour.columns import ROW
from tablescour.functions import dates
from tablescour.operators import dedupe, profile, validate
from tablescour.plans.spec import DedupeConfig, Rule


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_dedupe_sorts_no_whole_rows_by_key(table):
    df = table(k=["a", "b", "a", None, "", None], v=["1", "2", "3", "4", "5", "6"])
    for keep, rows in (("first", [0, 1, 3, 4]), ("last", [1, 2, 4, 5])):
        out = dedupe.with_copies(df, DedupeConfig("columns", ["k"], keep))
        assert "SortAggregate" not in _plan(out) and "min_by" not in _plan(out)
        got = {r[ROW]: (r.v, r[dedupe.COPIES]) for r in out.collect()}
        assert sorted(got) == rows and got[rows[0]] == (str(rows[0] + 1), 2 if keep == "first" else 1)


def test_large_sets_of_values_are_joined(table):
    df = table(v=["7", "x", "", None, "99999", "7"])
    values = [str(k) for k in range(100_000)] + ["7"]
    rule = Rule("v", "allowed_values", values=values)
    found = validate.failures(df, [rule, Rule("v", "allowed_values", values=["7"])])
    assert "99998" not in _plan(found)
    assert sorted((r.rule_no, r.row, r.value) for r in found.collect()) == [(0, 2, "x"), (1, 2, "x"), (1, 5, "99999")]
    assert validate.drop_invalid(df, [rule]).count() == 5


def test_two_digit_years_follow_the_reference_year(table):
    df = table(d=["01/02/35", "03/04/1990", "31/31/35"])
    for year, kind in ((2020, "date"), (1970, "date")):
        rules = [Rule("d", "date", reference_year=year), Rule("d", "date")]
        assert [r.row for r in validate.failures(df, rules).filter("rule_no = 0").collect()] == [3]
        assert profile.profile(df.limit(2), reference_year=year).first().detected_type == kind
    parsed = dates.with_parsed_dates(df, {"t": "d"}, reference_year=1970).orderBy(ROW).first().t
    assert parsed.year == 1935
