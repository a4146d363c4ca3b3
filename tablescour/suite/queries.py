"""One query per operator over the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablescour.columns import ROW
from tablescour.functions.canonical import to_canonical
from tablescour.operators import dedupe, mapping, match, merge, normalize, preview, profile, validate
from tablescour.plans import runs
from tablescour.plans.cleaning import CleaningPlan
from tablescour.plans.spec import DedupeConfig, NormalizeConfig, RenameConfig, Rule
from tablescour.session import shared_dir, tune
from tablescour.sinks import export as sinks
from tablescour.sources import ingest
from tablescour.sources.inventory import inventory
from tablescour.sources.snapshots import read_parquet
from tablescour.suite.views import table, view

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def _add(name: str, function: Query) -> None:
    QUERIES[name] = lambda spark, sf_dir: function(tune(spark), sf_dir)


def query(function: Query) -> Query:
    _add(function.__name__, function)
    return function


# --- typed tables to text -------------------------------------------------------------


def _canonical(name: str) -> Query:
    return lambda spark, sf: to_canonical(table(spark, sf, name))


for _name in ("orders", "events", "lineitem", "part", "customer"):
    _add(f"canonical_{_name}", _canonical(_name))


# --- normalization ---------------------------------------------------------------------


def _normalized(view_name: str, column: str, *operations: str, **options) -> Query:
    def run(spark, sf):
        spec = {"columns": [{"column": column, "operations": list(operations)}], **options}
        return normalize.normalize(view(spark, sf, view_name), NormalizeConfig.parse(spec)).select(
            ROW, column
        )

    return run


_add("norm_trim", _normalized("dirty_customer", "status", "trim"))
_add("norm_collapse", _normalized("dirty_customer", "cust_nm", "collapse_spaces"))
_add("norm_lower", _normalized("document_rows", "text", "lowercase"))
_add("norm_upper", _normalized("turn_rows", "text", "uppercase"))
_add("norm_title", _normalized("dirty_customer", "cust_nm", "title_case"))
_add("norm_title_documents", _normalized("document_rows", "text", "title_case"))
_add("norm_empty_to_null", _normalized("dirty_customer", "mail", "empty_to_null"))
_add("norm_null_tokens", _normalized("dirty_customer", "status", "null_tokens_to_null"))
_add("norm_phone", _normalized("dirty_customer", "ph_no", "normalize_phone"))
_add("norm_phone_documents", _normalized("document_rows", "text", "normalize_phone"))
_add("norm_date", _normalized("dirty_orders", "order_date", "normalize_date"))
_add("norm_date_dayfirst", _normalized("dirty_orders", "order_date", "normalize_date", day_first=True))
_add(
    "norm_date_format",
    _normalized("dirty_orders", "order_date", "normalize_date", date_format="%d %b %Y, day %j, %A"),
)
_add(
    "norm_chain",
    _normalized("dirty_customer", "status", "trim", "lowercase", "null_tokens_to_null", "title_case"),
)

CUSTOMER_NORMALIZE = {
    "columns": [
        {"column": "cust_nm", "operations": ["trim", "collapse_spaces", "title_case"]},
        {"column": "mail", "operations": ["trim", "lowercase", "empty_to_null"]},
        {"column": "ph_no", "operations": ["normalize_phone"]},
        {"column": "status", "operations": ["trim", "null_tokens_to_null", "uppercase"]},
    ]
}


@query
def norm_change_counts(spark, sf):
    config = NormalizeConfig.parse(CUSTOMER_NORMALIZE)
    return normalize.change_counts(view(spark, sf, "dirty_customer"), config)


@query
def norm_diff_samples(spark, sf):
    config = NormalizeConfig.parse(CUSTOMER_NORMALIZE)
    return normalize.change_samples(view(spark, sf, "dirty_customer"), config)


# --- validation ------------------------------------------------------------------------

CUSTOMER_RULES = [
    Rule("mail", "required"),
    Rule("mail", "email"),
    Rule("age", "numeric_range", min=0, max=120),
    Rule("cust_nm", "string_length", min_length=5, max_length=24),
    Rule("ph_no", "regex", pattern=r"[+0-9 ().]+"),
    Rule("status", "allowed_values", values=["BUILDING", "MACHINERY", "FURNITURE", " building  "]),
]
ORDER_RULES = [
    Rule("order_date", "date"),
    Rule("order_date", "required"),
    Rule("amount", "numeric_range", min=1000),
    Rule("order_status", "allowed_values", values=["O", "F", "P"]),
]


def _failures(view_name: str, *rules: Rule) -> Query:
    def run(spark, sf):
        found = validate.failures(view(spark, sf, view_name), rules)
        return found.select("rule", "row", F.coalesce("value", F.lit("")).alias("value"), "reason")

    return run


for _rule in (*CUSTOMER_RULES, ORDER_RULES[0]):
    _view = "dirty_orders" if _rule in ORDER_RULES else "dirty_customer"
    _add(f"val_{_rule.rule}", _failures(_view, _rule))
_add("val_regex_documents", _failures("document_rows", Rule("text", "regex", pattern=r"[^0-9]*")))


@query
def val_regex_class(spark, sf):
    """Words of all texts that a pattern with ``[`` and ``&&`` in a class does not match."""
    rows = table(spark, sf, "documents").select(
        F.col("doc_id").alias(ROW), F.explode(F.split("text", " ")).alias("word")
    )
    return validate.failures(rows, [Rule("word", "regex", pattern=r"(?P<a_b>[A-Za-z&&[.,]+)(?P<ab>s?)")]).select("row", "value")


_add(
    "val_allowed_large",
    _failures("dirty_orders", Rule("order_id", "allowed_values", values=[str(2 * k) for k in range(100_000)])),
)


@query
def val_summary(spark, sf):
    return validate.summarize(view(spark, sf, "dirty_customer"), CUSTOMER_RULES)


@query
def val_summary_orders(spark, sf):
    return validate.summarize(view(spark, sf, "dirty_orders"), ORDER_RULES)


@query
def val_samples(spark, sf):
    found = validate.samples(view(spark, sf, "dirty_customer"), CUSTOMER_RULES)
    return found.withColumn("value", F.coalesce("value", F.lit("")))


@query
def val_drop(spark, sf):
    return validate.drop_invalid(view(spark, sf, "dirty_orders"), ORDER_RULES)


# --- deduplication ---------------------------------------------------------------------


def _deduped(view_name: str, *keys: str, keep: str = "first") -> Query:
    config = DedupeConfig("columns" if keys else "exact", list(keys), keep)

    def run(spark, sf):
        return dedupe.deduplicate(view(spark, sf, view_name), config)

    return run


def _events_by_day(keep: str) -> Query:
    """Events without their unique columns, so that rows repeat."""

    def run(spark, sf):
        df = view(spark, sf, "event_rows").select(ROW, "kind", "on_day")
        return dedupe.deduplicate(df, DedupeConfig("exact", [], keep))

    return run


_add("dedupe_exact_first", _events_by_day("first"))
_add("dedupe_exact_last", _events_by_day("last"))
_add("dedupe_key_first", _deduped("dirty_customer", "mail"))
_add("dedupe_key_last", _deduped("dirty_customer", "mail", keep="last"))
_add("dedupe_composite", _deduped("dirty_orders", "cust_id", "order_status"))
_add("dedupe_documents", _deduped("document_rows", "text"))


@query
def dedupe_stats(spark, sf):
    return dedupe.stats(view(spark, sf, "dirty_customer"), DedupeConfig("columns", ["mail"]))


@query
def dedupe_removed(spark, sf):
    config = DedupeConfig("columns", ["mail"], "first")
    return dedupe.removed_samples(view(spark, sf, "dirty_customer"), config)


@query
def dedupe_removed_last(spark, sf):
    config = DedupeConfig("columns", ["mail", "status"], "last")
    return dedupe.removed_samples(view(spark, sf, "dirty_customer"), config)


@query
def dup_count(spark, sf):
    return dedupe.duplicate_count(view(spark, sf, "line_flags"))


@query
def dup_count_documents(spark, sf):
    return dedupe.duplicate_count(view(spark, sf, "document_rows"))


# --- columns and merges ----------------------------------------------------------------


@query
def map_rename_drop_reorder(spark, sf):
    config = RenameConfig(
        rename={"cust_nm": "customer_name", "mail": "email", "age": "status", "status": "age"},
        drop=["ph_no"],
        order=["email", "customer_name", "age", "status"],
    )
    return mapping.map_columns(view(spark, sf, "dirty_customer"), config)


def _inputs(spark, sf, mapped: bool = False):
    rename = {"client": "cust_nm"} if mapped else {}
    return [
        merge.MergeInput("customers", view(spark, sf, "dirty_customer")),
        merge.MergeInput("new batch", view(spark, sf, "new_batch"), rename),
    ]


@query
def merge_union(spark, sf):
    return merge.merge(_inputs(spark, sf), "union")


@query
def merge_intersection(spark, sf):
    return merge.merge(_inputs(spark, sf), "intersection")


@query
def merge_mapped(spark, sf):
    return merge.merge(_inputs(spark, sf, mapped=True), "union")


@query
def merge_stats(spark, sf):
    return merge.merge_stats(_inputs(spark, sf), "union")


@query
def row_labels(spark, sf):
    """Labels straight from the Parquet scan: contiguous and unique."""
    df = read_parquet(spark, f"{sf}/lineitem.parquet")
    return df.agg(
        F.count(F.lit(1)).alias("n"),
        F.min(ROW).alias("first"),
        F.max(ROW).alias("last"),
        F.sum(F.col(ROW)).alias("total"),
    )


@query
def row_relabel(spark, sf):
    """Gaps left by a filter are closed in row order."""
    from tablescour.operators.rows import renumber

    kept = validate.drop_invalid(view(spark, sf, "dirty_orders"), ORDER_RULES)
    return renumber(kept).select(ROW, "order_id")


@query
def preview_head(spark, sf):
    return preview.head(view(spark, sf, "dirty_orders"))


# --- profiles and reports --------------------------------------------------------------


def _profiled(df: DataFrame) -> DataFrame:
    return profile.profile(df).select(
        "name",
        "detected_type",
        "null_count",
        "unique_count",
        F.array_join("sample_values", "|").alias("sample_values"),
        F.coalesce("invalid_count", F.lit(-1)).alias("invalid_count"),
    )


def _profile_of(view_name: str) -> Query:
    return lambda spark, sf: _profiled(view(spark, sf, view_name))


for _view in ("dirty_customer", "dirty_orders", "event_rows", "document_rows"):
    _add(f"profile_{_view}", _profile_of(_view))


@query
def profile_typed_orders(spark, sf):
    return _profiled(to_canonical(table(spark, sf, "orders").withColumn(ROW, F.col("o_orderkey"))))


@query
def infer_types(spark, sf):
    return profile.profile(view(spark, sf, "dirty_orders")).select("name", "detected_type")


@query
def null_counts(spark, sf):
    return profile.null_counts(view(spark, sf, "dirty_customer"))


@query
def null_share(spark, sf):
    return profile.null_share(profile.null_counts(view(spark, sf, "dirty_customer")))


@query
def quality_report(spark, sf):
    original = view(spark, sf, "dirty_orders")
    current = dedupe.deduplicate(original, DedupeConfig("columns", ["cust_id"], "first"))
    return profile.quality_metrics(current, original)


# --- ordered steps ---------------------------------------------------------------------

DEMO_STEPS = [
    {
        "id": "norm",
        "type": "normalize",
        "config": {
            "columns": [
                {"column": "cust_nm", "operations": ["trim", "collapse_spaces", "title_case"]},
                {"column": "mail", "operations": ["lowercase"]},
                {"column": "status", "operations": ["trim", "uppercase", "null_tokens_to_null"]},
            ]
        },
    },
    {
        "id": "check",
        "type": "validate",
        "config": {
            "rules": [{"column": "age", "rule": "numeric_range", "min": 0, "max": 120}],
            "drop_invalid_rows": True,
        },
    },
    {"id": "dedupe", "type": "dedupe", "config": {"mode": "columns", "columns": ["mail"]}},
    {
        "id": "rename",
        "type": "rename",
        "config": {"rename": {"cust_nm": "customer_name", "mail": "email"}, "drop": ["ph_no"]},
    },
]
STATUS_STEPS = [
    {
        "id": "norm",
        "type": "normalize",
        "config": {"columns": [{"column": "status", "operations": ["trim", "uppercase"]}]},
    },
    {"id": "dedupe", "type": "dedupe", "config": {"mode": "columns", "columns": ["status"]}},
]


@query
def flow_demo(spark, sf):
    return CleaningPlan(DEMO_STEPS).apply(view(spark, sf, "dirty_customer"))


@query
def flow_order_sensitive(spark, sf):
    return CleaningPlan(STATUS_STEPS[::-1]).apply(view(spark, sf, "dirty_customer"))


@query
def flow_disabled_step(spark, sf):
    steps = [{**s, "enabled": s["id"] != "check"} for s in DEMO_STEPS]
    return CleaningPlan(steps).apply(view(spark, sf, "dirty_customer"))


@query
def flow_dry_run(spark, sf):
    return CleaningPlan(DEMO_STEPS).dry_run(view(spark, sf, "dirty_customer")).df


@query
def flow_step_report(spark, sf):
    """Counts of every step, from the aggregates a reported run makes."""
    result = CleaningPlan(DEMO_STEPS).run(view(spark, sf, "dirty_customer"))
    rows = [
        (s["step_id"], s["input_rows"], s["output_rows"], s["stats"].get("changed_cells", 0))
        for s in result.steps
    ]
    schema = "step_id string, input_rows bigint, output_rows bigint, changed_cells bigint"
    return spark.createDataFrame(rows, schema)


# --- output and input ------------------------------------------------------------------


@query
def export_guard(spark, sf):
    return sinks.guard(view(spark, sf, "dirty_orders"))


@query
def export_guard_count(spark, sf):
    return sinks.guarded_cells(view(spark, sf, "dirty_orders"))


@query
def export_roundtrip_csv(spark, sf):
    path = shared_dir(spark, "export")
    sinks.export(view(spark, sf, "document_rows"), "csv", path, guard_formulas=False)
    return ingest.load_csv(spark, f"{path}/*.csv").drop(ROW)


@query
def export_one_column(spark, sf):
    """All texts alone in their rows, and after each an empty one: no row may get lost."""
    path = shared_dir(spark, "export")
    rows = view(spark, sf, "document_rows").select((2 * F.col(ROW)).alias(ROW), "text")
    empty = rows.select((F.col(ROW) + 1).alias(ROW), F.lit("").alias("text"))
    sinks.export(rows.unionByName(empty), "csv", path, guard_formulas=False)
    return ingest.load_csv(spark, f"{path}/*.csv").drop(ROW)


@query
def csv_multiline(spark, sf):
    """Texts with a line end in place of each space, in files that are cut into blocks."""
    folder = shared_dir(spark, "multiline")
    rows = table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("doc_id"), F.replace(F.col("text"), F.lit(" "), F.lit("\n")).alias("text"), "lang"
    )
    rows.write.csv(f"{folder}/csv", header=True, quote='"', escape='"', nullValue="", emptyValue="",
                   ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return ingest.load_csv(spark, f"{folder}/csv/*.csv").drop(ROW)


@query
def csv_wide_header(spark, sf):
    """All orders in columns whose names make the header longer than a first read."""
    folder, width = shared_dir(spark, "wide"), 64
    names = [f"{'the_number_of_the_orders_with_remainder_' * 30}{k:02d}" for k in range(width)]
    place = F.col("o_orderkey") % width
    cells = [F.when(place == k, F.col("o_orderkey").cast("string")).otherwise("") for k in range(width)]
    lines = table(spark, sf, "orders").select(F.concat_ws(",", *cells).alias(",".join(names)))
    lines.write.csv(f"{folder}/csv", header=True, sep="\x01", quote="")
    loaded = ingest.load_csv(spark, f"{folder}/csv/*.csv").drop(ROW)
    pairs = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("cell")) for c in loaded.columns])
    return loaded.select(F.inline(F.filter(pairs, lambda p: p["cell"] != "")))


@query
def inventory_files(spark, sf):
    """What the files of four tables hold, each table in a layout and encoding of its own."""
    folder = shared_dir(spark, "inventory")
    customers, events = view(spark, sf, "dirty_customer").drop(ROW), view(spark, sf, "event_rows").drop(ROW)
    customers.write.csv(f"{folder}/semicolon", header=True, sep=";")
    events.withColumnRenamed("kind", "caf\u00e9").write.csv(f"{folder}/western", header=True, sep="\t", encoding="iso-8859-1")
    view(spark, sf, "document_rows").select("source", "text").write.csv(f"{folder}/breaks", header=True, escape='"')
    table(spark, sf, "nation").select("n_nationkey").write.parquet(f"{folder}/other")
    found = inventory(spark, [f"{folder}/*/*.csv", f"{folder}/other/*.parquet"])
    return found.select(
        F.element_at(F.split("path", "/"), -2).alias("folder"), "extension", "kind", "encoding", "delimiter",
        F.array_join("header", "/").alias("header"), "spans_lines", "status", "error_code",
    ).groupBy("folder", "extension", "kind", "encoding", "delimiter", "header", "status", "error_code").agg(
        F.bool_or("spans_lines").alias("spans_lines")
    )


@query
def export_roundtrip_json(spark, sf):
    path = shared_dir(spark, "export")
    df = view(spark, sf, "dirty_orders")
    sinks.export(df, "json", path)
    return spark.read.schema(df.drop(ROW).schema).json(path)


@query
def ingest_batch(spark, sf):
    """Three tables as CSV in three layouts, loaded as one batch of files."""
    folder = shared_dir(spark, "batch")
    for name, sep in (("dirty_customer", ";"), ("dirty_orders", ","), ("new_batch", "\t")):
        view(spark, sf, name).drop(ROW).write.csv(f"{folder}/in/{name}", header=True, sep=sep)
    outcome = ingest.ingest_many(spark, f"{folder}/in/*/*.csv", f"{folder}/out")
    return outcome.groupBy("status", "column_count").agg(F.sum("row_count").alias("row_count"))


@query
def csv_ragged_quarantine(spark, sf):
    """Order lines as CSV text in which every 50th record lacks a field."""
    folder = shared_dir(spark, "ragged")
    orders = view(spark, sf, "dirty_orders")
    whole = F.concat_ws("|", "order_id", "cust_id", "amount")
    cut = F.concat_ws("|", "order_id", "amount")
    lines = orders.select(F.when(F.col(ROW) % 50 == 0, cut).otherwise(whole).alias("value"))
    lines.withColumnRenamed("value", "order_id|cust_id|amount").write.csv(
        f"{folder}/in", header=True, sep="\x01", quote=""
    )
    good = ingest.load_csv(spark, f"{folder}/in/*.csv", f"{folder}/out", on_ragged="quarantine")
    bad = spark.read.parquet(f"{folder}/out/quarantine")
    return good.agg(F.lit("good").alias("part"), F.count(F.lit(1)).alias("n")).unionByName(
        bad.agg(F.lit("bad").alias("part"), F.count(F.lit(1)).alias("n"))
    )


# --- run history and schema matching ---------------------------------------------------


def _event_log(spark, sf) -> DataFrame:
    """Events read as run records: a user is a dataset, the event type is the kind."""
    return table(spark, sf, "events").select(
        F.lpad(F.col("event_id").cast("string"), 12, "0").alias("run_id"),
        F.col("user_id").cast("string").alias("dataset_id"),
        F.col("event_type").alias("kind"),
        F.lit("success").alias("status"),
        F.format_string('{"row_count": %d, "column_count": 3}', "event_id").alias("summary"),
        F.col("ts").alias("created_at"),
    )


@query
def runs_last_per_kind(spark, sf):
    last = runs.last_per(_event_log(spark, sf), "dataset_id", "kind")
    return last.select("dataset_id", "kind", "run_id", "summary")


@query
def runs_history(spark, sf):
    return runs.history(_event_log(spark, sf), kind="click").select("run_id", "dataset_id")


@query
def runs_catalog(spark, sf):
    made = runs.catalog(_event_log(spark, sf))
    return made.select("dataset_id", "row_count", "column_count", "status")


def _words(spark, sf) -> DataFrame:
    """The words of all documents and item names as a catalog of column names."""
    texts = table(spark, sf, "documents").select(F.lit("documents").alias("table"), "text")
    names = table(spark, sf, "part").select(F.lit("part").alias("table"), F.col("p_name").alias("text"))
    words = F.explode(F.split(F.lower("text"), r"[^\p{L}\p{N}_]+")).alias("column")
    return texts.unionByName(names).select("table", words).filter("column <> ''").distinct()


@query
def match_columns(spark, sf):
    return match.suggest(_words(spark, sf))


@query
def match_spellings(spark, sf):
    """Names in need of similarity and substring tests, several in each supplier's file."""
    number = F.col("s_suppkey").cast("string")
    spellings = {
        "phon": "near", "statuss": "near", "customr_name": "near", "countryx": "near",
        "total_paid_": "part", "my_city_": "part", "zzqqx_": "none",
    }
    names = [F.lit(k) if v == "near" else F.concat(F.lit(k), number) for k, v in spellings.items()]
    files = table(spark, sf, "supplier").select(
        F.col("s_name").alias("table"), F.explode(F.array(*names)).alias("column")
    )
    return match.suggest(files).select("table", "column", "target", "confidence", "rationale")


@query
def match_known_names(spark, sf):
    """Spellings of target names per supplier file, matched exactly or as synonyms."""
    spellings = F.array(*[F.lit(s) for s in ("Cust NM", "E-Mail", "Tel.", "order_no", "Town", "IBAN")])
    files = table(spark, sf, "supplier").select(
        F.col("s_name").alias("table"),
        F.element_at(spellings, (F.col("s_suppkey") % 6 + 1).cast("int")).alias("column"),
    )
    found = match.suggest(files, ["customer_name", "email", "phone", "order_id", "city"])
    return found.select("table", "column", "target", "confidence")
