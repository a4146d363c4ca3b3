"""Headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR; prints one JSON line.

Each query is planned and run to a sink that keeps nothing, twice; the better time counts.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import functions as F

from tablescour.columns import ROW, data_columns
from tablescour.functions.canonical import to_canonical
from tablescour.operators import normalize, profile, validate
from tablescour.plans.spec import NormalizeConfig, Rule
from tablescour.session import local_session
from tablescour.suite.queries import QUERIES
from tablescour.suite.views import table

SUITE = [
    "canonical_lineitem",
    "norm_chain",
    "norm_date",
    "norm_change_counts",
    "norm_title_documents",
    "val_summary",
    "val_summary_orders",
    "val_samples",
    "val_drop",
    "dedupe_key_first",
    "dedupe_composite",
    "dedupe_documents",
    "dup_count",
    "dup_count_documents",
    "merge_union",
    "row_relabel",
    "profile_dirty_customer",
    "profile_dirty_orders",
    "profile_document_rows",
    "quality_report",
    "flow_demo",
    "flow_step_report",
    "export_guard",
    "export_roundtrip_csv",
    "match_columns",
]


def _lineitem(spark, sf):
    return to_canonical(table(spark, sf, "lineitem").withColumn(ROW, F.monotonically_increasing_id()))


def lineitem_nine_operations(spark, sf):
    """Every normalization operation, over all text columns of the largest table."""
    df = _lineitem(spark, sf)
    chains = {
        "l_returnflag": ["trim", "collapse_spaces", "lowercase", "uppercase", "title_case"],
        "l_linestatus": ["empty_to_null", "null_tokens_to_null"],
        "l_shipdate": ["normalize_date"],
        "l_partkey": ["normalize_phone"],
    }
    columns = [{"column": c, "operations": ops} for c, ops in chains.items()]
    config = NormalizeConfig.parse({"columns": columns, "date_format": "%d/%m/%Y"})
    return normalize.normalize(df, config)


def lineitem_profile(spark, sf):
    return profile.profile(_lineitem(spark, sf))


def lineitem_seven_rules(spark, sf):
    rules = [
        Rule("l_shipdate", "date"),
        Rule("l_quantity", "numeric_range", min=1, max=40),
        Rule("l_discount", "required"),
        Rule("l_returnflag", "allowed_values", values=["A", "N"]),
        Rule("l_linestatus", "regex", pattern="[A-Z]"),
        Rule("l_extendedprice", "string_length", max_length=8),
        Rule("l_partkey", "email"),
    ]
    return validate.summarize(_lineitem(spark, sf), rules)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    spark = local_session(cpus, **{"spark.sql.shuffle.partitions": cpus})
    spark.sparkContext.setLogLevel("ERROR")
    chosen = {name: QUERIES[name] for name in SUITE}
    for extra in (lineitem_nine_operations, lineitem_seven_rules, lineitem_profile):
        chosen[extra.__name__] = extra
    wanted = sys.argv[1:] or list(chosen)
    times = {}
    for name in wanted:
        runs = []
        for _ in range(2):
            start = time.perf_counter()
            df = chosen[name](spark, sf_dir)
            assert data_columns(df)
            df.write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        times[name] = round(min(runs), 3)
        print(name, [round(r, 2) for r in runs], file=sys.stderr, flush=True)
    result = {
        "metric": "total_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(result))


if __name__ == "__main__":
    main()
