"""Per-column chains of text, null, date and phone operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablescour.columns import ROW, data_columns, differs, ref, require_columns, shown
from tablescour.errors import CleanError
from tablescour.functions import text
from tablescour.functions.dates import with_parsed_dates
from tablescour.functions.strftime import check_format, strftime
from tablescour.plans.spec import NormalizeConfig

_PLAIN = {
    "trim": text.trim,
    "collapse_spaces": text.collapse_spaces,
    "lowercase": F.lower,
    "uppercase": F.upper,
    "title_case": text.title_case,
    "empty_to_null": text.empty_to_null,
    "normalize_phone": text.phone_digits,
}
SAMPLES = 5


def check(df: DataFrame, config: NormalizeConfig) -> None:
    names = [c.column for c in config.columns]
    require_columns(df, names, "Normalization")
    for name in names:
        if names.count(name) > 1:
            raise CleanError(
                "duplicate_column_operation",
                f"A normalize step lists a column once; '{name}' comes again.",
                column=name,
            )
    if any("normalize_date" in c.operations for c in config.columns):
        check_format(config.date_format)


def _staged(df: DataFrame, config: NormalizeConfig, keep_stages: bool) -> DataFrame:
    """Run operation k of every column in the k-th projection.

    With ``keep_stages`` the result of each operation stays as ``__op_<column>_<k>``,
    where stage 0 is the value before the first one.
    """
    columns = df.columns
    chains = {c.column: list(c.operations) for c in config.columns}
    position = {c: i for i, c in enumerate(chains)}
    out = df
    if keep_stages:
        out = out.select("*", *[ref(c).alias(f"__op_{i}_0") for c, i in position.items()])
    for wave in range(max(len(ops) for ops in chains.values())):
        due = {c: ops[wave] for c, ops in chains.items() if wave < len(ops)}
        dates = {f"__parsed_{position[c]}": c for c, op in due.items() if op == "normalize_date"}
        stage = with_parsed_dates(out, dates, config.day_first, config.reference_year)
        made = {}
        for column, op in due.items():
            value = ref(column)
            if op == "normalize_date":
                parsed = F.col(f"__parsed_{position[column]}")
                made[column] = F.coalesce(strftime_of(parsed, config.date_format), value)
            elif op == "null_tokens_to_null":
                made[column] = text.null_words_to_null(value, config.null_tokens)
            else:
                made[column] = _PLAIN[op](value)
        out = stage.select(*[made[c].alias(c) if c in made else ref(c) for c in out.columns])
        if keep_stages:
            out = out.select("*", *[ref(c).alias(f"__op_{position[c]}_{wave + 1}") for c in due])
    return out if keep_stages else out.select(*[ref(c) for c in columns])


def strftime_of(parsed: Column, fmt: str) -> Column:
    """The format applied to parsed values only, so that constants stay off the others."""
    return F.when(parsed.isNotNull(), strftime(parsed, fmt))


def normalize(df: DataFrame, config: NormalizeConfig) -> DataFrame:
    check(df, config)
    return _staged(df, config, keep_stages=False)


def with_stages(df: DataFrame, config: NormalizeConfig) -> DataFrame:
    """The normalized frame plus its ``__op_`` stage columns, for counting."""
    check(df, config)
    return _staged(df, config, keep_stages=True)


def counters(config: NormalizeConfig) -> list[tuple[str, str, Column]]:
    """(column, operation, changed-cell flag) per operation over ``with_stages``."""
    return [
        (chain.column, op, differs(F.col(f"__op_{i}_{k}"), F.col(f"__op_{i}_{k + 1}")))
        for i, chain in enumerate(config.columns)
        for k, op in enumerate(chain.operations)
    ]


def fold_counts(
    config: NormalizeConfig, counts: list[Column]
) -> dict[str, dict[str, Column]]:
    """One count per (column, operation), from the counts in ``counters`` order.

    An operation named twice for a column reports its last count that is not zero.
    """
    out: dict[str, dict[str, Column]] = {c.column: {} for c in config.columns}
    for (column, op, _), n in zip(counters(config), counts):
        earlier = out[column].get(op)
        out[column][op] = n if earlier is None else F.when(n > 0, n).otherwise(earlier)
    return out


def cell_changes(config: NormalizeConfig) -> list[tuple[str, Column]]:
    """(column, changed-cell flag) from the first stage to the last."""
    return [
        (chain.column, differs(F.col(f"__op_{i}_0"), F.col(f"__op_{i}_{len(chain.operations)}")))
        for i, chain in enumerate(config.columns)
    ]


def change_counts(df: DataFrame, config: NormalizeConfig) -> DataFrame:
    """One row per (column, operation): how many cells it changed; one aggregate in all.

    A column whose operations change nothing has one row ``no_changes`` with the number
    of input rows, and operations without effect have none.
    """
    flags = counters(config)
    sums = with_stages(df, config).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(flag).alias(f"c{i}") for i, (_, _, flag) in enumerate(flags)],
    )
    entries = []
    folded = fold_counts(config, [F.col(f"c{i}") for i in range(len(flags))])
    for column, per_op in folded.items():
        entries += [(column, op, n, n > 0) for op, n in per_op.items()]
        quiet = sum(per_op.values(), F.lit(0)) == 0
        entries.append((column, "no_changes", F.col("n"), quiet))
    rows = F.array(
        *[
            F.when(
                show,
                F.struct(
                    F.lit(c).alias("column"), F.lit(op).alias("operation"), n.alias("changed")
                ),
            )
            for c, op, n, show in entries
        ]
    )
    return sums.select(F.inline(F.array_compact(rows)))


def change_samples(df: DataFrame, config: NormalizeConfig, limit: int = SAMPLES) -> DataFrame:
    """The first changed cells, by column position and then by row (1-based)."""
    order = {c: i for i, c in enumerate(data_columns(df))}
    staged = with_stages(df, config)
    cells = [
        F.when(
            flag,
            F.struct(
                F.lit(order[column]).alias("pos"),
                (F.col(ROW) + 1).alias("row"),
                F.lit(column).alias("column"),
                shown(F.col(f"__op_{i}_0")).alias("before"),
                shown(ref(column)).alias("after"),
            ),
        )
        for i, (column, flag) in enumerate(cell_changes(config))
    ]
    exploded = staged.select(F.inline(F.array_compact(F.array(*cells))))
    return exploded.orderBy("pos", "row").limit(limit).drop("pos")
