"""The same results in plain SQL, for an independent engine to check."""

from __future__ import annotations

from tablescour.operators.match import EXACT, SYNONYM, SYNONYMS, TARGETS, plain_name
from tablescour.suite.queries import CUSTOMER_RULES, ORDER_RULES
from tablescour.suite.views import VIEWS, view_sql, with_views

ORACLE: dict[str, str] = {}

EMAIL = r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$"
NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
TITLE_RUNS = r"([\p{Lu}\p{Ll}\p{Lt}]+|[^\p{Lu}\p{Ll}\p{Lt}]+)"
NULL_WORDS = "('null', 'n/a', 'na', 'none', 'nan', '-')"
BOOLEAN_WORDS = "('true', 'false', 'yes', 'no', 'y', 'n', 't', 'f')"


def _trim(v: str) -> str:
    return rf"regexp_replace({v}, '^\s+|\s+$', '', 'g')"


def _collapse(v: str) -> str:
    return rf"regexp_replace({v}, '\s+', ' ', 'g')"


def _title(v: str) -> str:
    return (
        f"array_to_string(list_transform(regexp_extract_all({v}, '{TITLE_RUNS}'), "
        "lambda w: regexp_replace(upper(w[1:1]), '[ßẞ]', 'Ss') || lower(w[2:])), '')"
    )


def _null_words(v: str) -> str:
    return f"CASE WHEN lower({_trim(v)}) IN {NULL_WORDS} THEN NULL ELSE {v} END"


def _number(v: str) -> str:
    return f"CASE WHEN regexp_matches({v}, '{NUMBER}') THEN TRY_CAST(trim({v}) AS DOUBLE) END"


def _date(v: str, day_first: bool = False) -> str:
    slashes = ["%d/%m/%Y", "%m/%d/%Y"] if day_first else ["%m/%d/%Y", "%d/%m/%Y"]
    formats = ["%Y-%m-%d", *slashes, "%b %d, %Y", "%d %B %Y", "%Y.%m.%d"]
    return f"coalesce({', '.join(f'try_strptime({v}, {f!r})' for f in formats)})"


def _one(view_name: str, column: str, expression: str) -> str:
    return f'SELECT _row, {expression} AS "{column}" FROM ({view_sql(view_name)})'


def _canonical(table: str, **columns: str) -> str:
    casts = {
        "text": "coalesce({c}, '')",
        "int": "coalesce(CAST({c} AS VARCHAR), '')",
        "float": "CASE WHEN {c} = floor({c}) THEN CAST(CAST({c} AS BIGINT) AS VARCHAR) "
        "ELSE CAST({c} AS VARCHAR) END",
        "stamp": "CASE WHEN strftime({c}, '%H:%M:%S') = '00:00:00' THEN strftime({c}, '%Y-%m-%d') "
        "ELSE strftime({c}, '%Y-%m-%d %H:%M:%S') END",
    }
    exprs = [f"{casts[kind].format(c=c)} AS {c}" for c, kind in columns.items()]
    return f"SELECT {', '.join(exprs)} FROM {table}"


ORACLE["canonical_orders"] = _canonical(
    "orders", o_orderkey="int", o_custkey="int", o_orderstatus="text", o_totalprice="float",
    o_orderdate="stamp", o_orderpriority="text",
)
ORACLE["canonical_events"] = _canonical(
    "events", event_id="int", ts="stamp", user_id="int", event_type="text", value="float", props="text"
)
ORACLE["canonical_lineitem"] = _canonical(
    "lineitem", l_orderkey="int", l_partkey="int", l_suppkey="int", l_linenumber="int",
    l_quantity="float", l_extendedprice="float", l_discount="float", l_tax="float",
    l_returnflag="text", l_linestatus="text", l_shipdate="stamp",
)
ORACLE["canonical_part"] = _canonical(
    "part", p_partkey="int", p_name="text", p_brand="text", p_type="text", p_size="int",
    p_retailprice="float",
)
ORACLE["canonical_customer"] = _canonical(
    "customer", c_custkey="int", c_name="text", c_nationkey="int", c_acctbal="float",
    c_mktsegment="text",
)

ORACLE["norm_trim"] = _one("dirty_customer", "status", _trim("status"))
ORACLE["norm_collapse"] = _one("dirty_customer", "cust_nm", _collapse("cust_nm"))
ORACLE["norm_lower"] = _one("document_rows", "text", "lower(text)")
ORACLE["norm_upper"] = _one("turn_rows", "text", "regexp_replace(upper(text), '[ßẞ]', 'SS', 'g')")
ORACLE["norm_title"] = _one("dirty_customer", "cust_nm", _title("cust_nm"))
ORACLE["norm_title_documents"] = _one("document_rows", "text", _title("text"))
ORACLE["norm_empty_to_null"] = _one("dirty_customer", "mail", "nullif(mail, '')")
ORACLE["norm_null_tokens"] = _one("dirty_customer", "status", _null_words("status"))
ORACLE["norm_phone"] = _one("dirty_customer", "ph_no", r"regexp_replace(ph_no, '[^\p{Nd}+]', '', 'g')")
ORACLE["norm_phone_documents"] = _one(
    "document_rows", "text", r"regexp_replace(text, '[^\p{Nd}+]', '', 'g')"
)
for _name, _day_first, _format in (
    ("norm_date", False, "%Y-%m-%d"),
    ("norm_date_dayfirst", True, "%Y-%m-%d"),
    ("norm_date_format", False, "%d %b %Y, day %j, %A"),
):
    _parsed = _date("order_date", _day_first)
    ORACLE[_name] = _one(
        "dirty_orders", "order_date", f"coalesce(strftime({_parsed}, '{_format}'), order_date)"
    )
_chained = _null_words(f"lower({_trim('status')})")
ORACLE["norm_chain"] = f"""
    SELECT _row, {_title("s")} AS status
    FROM (SELECT _row, {_chained} AS s FROM ({view_sql("dirty_customer")}))"""

# Every operation of the customer chains, step by step.
_STAGES = f"""{with_views("dirty_customer")},
stages AS (
  SELECT _row, cust_nm AS n0, {_trim("cust_nm")} AS n1, {_collapse(_trim("cust_nm"))} AS n2,
         {_title(_collapse(_trim("cust_nm")))} AS n3,
         mail AS m0, {_trim("mail")} AS m1, lower({_trim("mail")}) AS m2,
         nullif(lower({_trim("mail")}), '') AS m3,
         ph_no AS p0, regexp_replace(ph_no, '[^0-9+]', '', 'g') AS p1,
         status AS s0, {_trim("status")} AS s1, {_null_words(_trim("status"))} AS s2,
         upper({_null_words(_trim("status"))}) AS s3
  FROM dirty_customer)"""
_OPS = [
    ("cust_nm", "trim", "n0", "n1"),
    ("cust_nm", "collapse_spaces", "n1", "n2"),
    ("cust_nm", "title_case", "n2", "n3"),
    ("mail", "trim", "m0", "m1"),
    ("mail", "lowercase", "m1", "m2"),
    ("mail", "empty_to_null", "m2", "m3"),
    ("ph_no", "normalize_phone", "p0", "p1"),
    ("status", "trim", "s0", "s1"),
    ("status", "null_tokens_to_null", "s1", "s2"),
    ("status", "uppercase", "s2", "s3"),
]
_counts = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", '{op}' AS operation, count(*) FILTER "
    f"(WHERE coalesce({a}, '') <> coalesce({b}, '')) AS changed FROM stages"
    for c, op, a, b in _OPS
)
ORACLE["norm_change_counts"] = f"""{_STAGES}, counted AS ({_counts})
    SELECT * FROM counted WHERE changed > 0
    UNION ALL
    SELECT "column", 'no_changes', (SELECT count(*) FROM stages) FROM counted
    GROUP BY "column" HAVING max(changed) = 0"""
_cells = " UNION ALL ".join(
    f"SELECT {pos} AS pos, _row + 1 AS row, '{c}' AS \"column\", nullif({a}, '') AS before, "
    f"nullif({b}, '') AS after FROM stages WHERE coalesce({a}, '') <> coalesce({b}, '')"
    for pos, (c, a, b) in enumerate(
        [("cust_nm", "n0", "n3"), ("mail", "m0", "m3"), ("ph_no", "p0", "p1"), ("status", "s0", "s3")]
    )
)
ORACLE["norm_diff_samples"] = f"""{_STAGES}
    SELECT row, "column", before, after FROM ({_cells}) ORDER BY pos, row LIMIT 5"""


def _broken(rule) -> tuple[str, str]:
    """SQL for 'present and bad', and for the reason."""
    v = f'"{rule.column}"'
    if rule.rule == "required":
        return f"({v} IS NULL OR {v} = '')", "'value is empty'"
    if rule.rule == "email":
        bad, why = f"NOT regexp_matches({v}, '{EMAIL}')", "'not a valid email address'"
    elif rule.rule == "numeric_range":
        n = _number(v)
        low = float(rule.min) if rule.min is not None else "-inf"
        high = float(rule.max) if rule.max is not None else "inf"
        tests = [f"({n}) IS NULL"]
        tests += [f"({n}) < {rule.min}"] if rule.min is not None else []
        tests += [f"({n}) > {rule.max}"] if rule.max is not None else []
        bad = " OR ".join(tests)
        why = f"CASE WHEN ({n}) IS NULL THEN 'not a number' ELSE 'value out of range [{low}, {high}]' END"
    elif rule.rule == "string_length":
        bad = f"length({v}) NOT BETWEEN {rule.min_length} AND {rule.max_length}"
        why = f"'length outside {rule.min_length}-{rule.max_length} characters'"
    elif rule.rule == "date":
        bad, why = f"{_date(v)} IS NULL", "'not a parseable date'"
    elif rule.rule == "regex":
        bad = f"NOT regexp_full_match({v}, '{rule.pattern}')"
        why = "'does not match the required pattern'"
    else:
        listed = ", ".join(f"'{x}'" for x in rule.values)
        bad, why = f"{v} NOT IN ({listed})", "'value is not in the allowed set'"
    return f"({v} <> '' AND ({bad}))", why


def _failing(rules, source: str) -> str:
    parts = []
    for i, rule in enumerate(rules):
        bad, why = _broken(rule)
        parts.append(
            f"SELECT {i} AS rule_no, '{rule.column}' AS \"column\", '{rule.rule}' AS rule, "
            f"_row + 1 AS row, coalesce(\"{rule.column}\", '') AS value, {why} AS reason "
            f"FROM {source} WHERE {bad}"
        )
    return " UNION ALL ".join(parts)


def _summary(rules, source: str) -> str:
    parts = []
    for i, rule in enumerate(rules):
        bad, _ = _broken(rule)
        parts.append(
            f"SELECT {i} AS rule_no, '{rule.column}' AS \"column\", '{rule.rule}' AS rule, "
            f"count(*) FILTER (WHERE \"{rule.column}\" <> '') AS total_values, "
            f"count(*) FILTER (WHERE {bad}) AS error_count FROM {source}"
        )
    return (
        "SELECT *, CASE WHEN total_values > 0 THEN round(error_count / total_values, 4) ELSE 0.0 END "
        f"AS error_rate, error_count = 0 AS passed FROM ({' UNION ALL '.join(parts)})"
    )


for _rule in (*CUSTOMER_RULES, ORDER_RULES[0]):
    _view = "dirty_orders" if _rule in ORDER_RULES else "dirty_customer"
    ORACLE[f"val_{_rule.rule}"] = (
        f"{with_views(_view)} SELECT rule, row, value, reason FROM ({_failing([_rule], _view)})"
    )
ORACLE["val_regex_documents"] = f"""
    SELECT 'regex' AS rule, _row + 1 AS row, text AS value,
           'does not match the required pattern' AS reason
    FROM ({view_sql("document_rows")}) WHERE text <> '' AND regexp_matches(text, '[0-9]')"""
ORACLE["val_summary"] = f"{with_views('dirty_customer')} {_summary(CUSTOMER_RULES, 'dirty_customer')}"
ORACLE["val_summary_orders"] = f"{with_views('dirty_orders')} {_summary(ORDER_RULES, 'dirty_orders')}"
ORACLE["val_samples"] = f"""{with_views("dirty_customer")}
    SELECT rule_no, "column", rule, row, value, reason FROM (
      SELECT *, row_number() OVER (PARTITION BY rule_no ORDER BY row) AS rank
      FROM ({_failing(CUSTOMER_RULES, "dirty_customer")})) WHERE rank <= 5"""
_bad_order = " OR ".join(_broken(r)[0] for r in ORDER_RULES)
ORACLE["val_drop"] = f"{with_views('dirty_orders')} SELECT * FROM dirty_orders WHERE NOT ({_bad_order})"


def _kept(source: str, keys: str, keep: str = "first", columns: str = "*") -> str:
    order = "_row" if keep == "first" else "_row DESC"
    return (
        f"SELECT {columns} FROM {source} "
        f"QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY {order}) = 1"
    )


_events = "(SELECT _row, kind, on_day FROM event_rows)"
for _keep in ("first", "last"):
    ORACLE[f"dedupe_exact_{_keep}"] = (
        f"{with_views('event_rows')} {_kept(_events, 'kind, on_day', _keep)}"
    )
    ORACLE[f"dedupe_key_{_keep}"] = (
        f"{with_views('dirty_customer')} {_kept('dirty_customer', 'mail', _keep)}"
    )
ORACLE["dedupe_composite"] = (
    f"{with_views('dirty_orders')} {_kept('dirty_orders', 'cust_id, order_status')}"
)
ORACLE["dedupe_documents"] = f"{with_views('document_rows')} {_kept('document_rows', 'text')}"
ORACLE["dedupe_stats"] = f"""{with_views("dirty_customer")}
    SELECT CAST(sum(CASE WHEN n > 1 THEN n ELSE 0 END) AS BIGINT) AS duplicate_rows_involved,
           CAST(sum(n - 1) AS BIGINT) AS rows_removed, count(*) AS output_rows
    FROM (SELECT count(*) AS n FROM dirty_customer GROUP BY mail)"""
ORACLE["dedupe_removed"] = f"""{with_views("dirty_customer")}
    SELECT * FROM dirty_customer
    QUALIFY row_number() OVER (PARTITION BY mail ORDER BY _row) > 1 ORDER BY _row LIMIT 5"""
ORACLE["dedupe_removed_last"] = f"""{with_views("dirty_customer")}
    SELECT * FROM dirty_customer
    QUALIFY row_number() OVER (PARTITION BY mail, status ORDER BY _row DESC) > 1
    ORDER BY _row LIMIT 5"""
for _name, _view in (("dup_count", "line_flags"), ("dup_count_documents", "document_rows")):
    _columns = ", ".join(f'"{c}"' for c in VIEWS[_view][1] if c != "_row")
    ORACLE[_name] = f"""{with_views(_view)}
        SELECT (SELECT count(*) FROM {_view})
             - (SELECT count(*) FROM (SELECT DISTINCT {_columns} FROM {_view})) AS duplicate_rows"""

ORACLE["map_rename_drop_reorder"] = f"""
    SELECT _row, mail AS email, cust_nm AS customer_name, status AS age, age AS status
    FROM ({view_sql("dirty_customer")})"""
_shifted = "_row + (SELECT count(*) FROM dirty_customer) AS _row"
_both = with_views("dirty_customer", "new_batch")
ORACLE["merge_union"] = f"""{_both}
    SELECT *, NULL AS client, NULL AS region FROM dirty_customer
    UNION ALL BY NAME SELECT {_shifted}, client, mail, region FROM new_batch"""
ORACLE["merge_mapped"] = f"""{_both}
    SELECT *, NULL AS region FROM dirty_customer
    UNION ALL BY NAME SELECT {_shifted}, client AS cust_nm, mail, region FROM new_batch"""
ORACLE["merge_intersection"] = f"""{_both}
    SELECT _row, mail FROM dirty_customer UNION ALL SELECT {_shifted}, mail FROM new_batch"""
ORACLE["merge_stats"] = """
    SELECT 0 AS input, 'customers' AS name, count(*) AS rows, 5 AS columns,
           count(*) * 2 AS null_cells_filled FROM customer
    UNION ALL
    SELECT 1, 'new batch', count(*), 3, count(*) * 4 FROM customer"""
ORACLE["row_labels"] = """
    SELECT count(*) AS n, 0 AS first, count(*) - 1 AS last,
           count(*) * (count(*) - 1) // 2 AS total FROM lineitem"""
ORACLE["row_relabel"] = f"""{with_views("dirty_orders")}
    SELECT row_number() OVER (ORDER BY _row) - 1 AS _row, order_id
    FROM dirty_orders WHERE NOT ({_bad_order})"""
ORACLE["preview_head"] = f"{view_sql('dirty_orders')} ORDER BY _row LIMIT 50"


def _column_profile(column: str) -> str:
    v = f'"{column}"'
    solid = f"{_trim(v)} <> ''"
    tests = {
        "ints": rf"regexp_matches({v}, '^[+-]?\p{{Nd}}+$')",
        "floats": rf"regexp_matches({v}, '^[+-]?(\p{{Nd}}+\.\p{{Nd}}*|\.\p{{Nd}}+|\p{{Nd}}+)([eE][+-]?\p{{Nd}}+)?$')",
        "words": f"lower({_trim(v)}) IN {BOOLEAN_WORDS}",
        "emails": f"regexp_matches({v}, '{EMAIL}')",
        "phones": rf"regexp_matches({v}, '^\+?[\p{{Nd}}\s()./-]{{7,25}}$') "
        rf"AND length(regexp_replace({v}, '\P{{Nd}}', '', 'g')) BETWEEN 7 AND 15",
    }
    sums = ", ".join(f"count(*) FILTER (WHERE {solid} AND {t}) AS {n}" for n, t in tests.items())
    firsts = f"(SELECT {v} AS x, min(_row) AS r FROM source WHERE {v} <> '' GROUP BY 1)"
    return f"""
    SELECT '{column}' AS name,
      CASE WHEN solid = 0 THEN 'empty' WHEN ints / solid >= 0.9 THEN 'integer'
           WHEN floats / solid >= 0.9 THEN 'float' WHEN words / solid >= 0.9 THEN 'boolean'
           WHEN head > head_ints AND head_dates / head >= 0.9 THEN 'date'
           WHEN emails / solid >= 0.7 THEN 'email' WHEN phones / solid >= 0.7 THEN 'phone'
           ELSE 'string' END AS detected_type,
      null_count, unique_count, sample_values, bad_emails, bad_dates
    FROM (SELECT count(*) FILTER (WHERE {solid}) AS solid, {sums},
                 count(*) FILTER (WHERE {v} IS NULL OR {v} = '') AS null_count,
                 count(DISTINCT {v}) FILTER (WHERE {v} <> '') AS unique_count,
                 count(*) FILTER (WHERE {v} <> '' AND NOT {tests["emails"]}) AS bad_emails,
                 count(*) FILTER (WHERE {v} <> '' AND {_date(v)} IS NULL) AS bad_dates
          FROM source),
         (SELECT count(*) AS head, count(*) FILTER (WHERE {tests["ints"].replace(v, "x")}) AS head_ints,
                 count(*) FILTER (WHERE {_date("x")} IS NOT NULL) AS head_dates
          FROM (SELECT x FROM {firsts} WHERE {_trim("x")} <> '')),
         (SELECT coalesce(string_agg(x, '|' ORDER BY r), '') AS sample_values
          FROM (SELECT x, r FROM {firsts} ORDER BY r LIMIT 3))"""


def _profile(source: str, columns: list[str]) -> str:
    parts = " UNION ALL ".join(_column_profile(c) for c in columns)
    return f"""WITH source AS ({source}), columns AS ({parts})
    SELECT name, detected_type, null_count, unique_count, sample_values,
           CASE WHEN detected_type = 'email' THEN bad_emails
                WHEN detected_type IN ('date', 'datetime') THEN bad_dates ELSE -1 END AS invalid_count
    FROM columns"""


def _columns_of(view_name: str) -> list[str]:
    return [c for c in VIEWS[view_name][1] if c != "_row"]


for _view in ("dirty_customer", "dirty_orders", "event_rows", "document_rows"):
    ORACLE[f"profile_{_view}"] = _profile(view_sql(_view), _columns_of(_view))
_typed = ORACLE["canonical_orders"].replace("SELECT ", "SELECT o_orderkey AS _row, ", 1)
ORACLE["profile_typed_orders"] = _profile(
    _typed,
    ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
)
ORACLE["infer_types"] = (
    f"SELECT name, detected_type FROM ({ORACLE['profile_dirty_orders']})"
)
_nulls = " UNION ALL ".join(
    f"SELECT {i} AS pos, '{c}' AS name, count(*) FILTER (WHERE \"{c}\" = '') AS null_count, "
    "count(*) AS row_count FROM dirty_customer"
    for i, c in enumerate(_columns_of("dirty_customer"))
)
ORACLE["null_counts"] = f"{with_views('dirty_customer')} {_nulls}"
ORACLE["null_share"] = f"""{with_views("dirty_customer")}
    SELECT pos, name, CAST(round(100 * null_count / row_count) AS INT) AS null_pct FROM ({_nulls})"""
_current = f"SELECT * FROM ({_kept(f'({view_sql("dirty_orders")})', 'cust_id')})"
_report_profile = _profile(_current, _columns_of("dirty_orders"))
ORACLE["quality_report"] = f"""WITH current AS ({_current}), columns AS ({_report_profile})
    SELECT 'total_rows' AS metric, count(*) AS value FROM current
    UNION ALL SELECT 'total_columns', 6
    UNION ALL SELECT 'null_cells_total', CAST(sum(null_count) AS BIGINT) FROM columns
    UNION ALL SELECT 'invalid_email_count',
      CAST(sum(CASE WHEN detected_type = 'email' THEN invalid_count ELSE 0 END) AS BIGINT) FROM columns
    UNION ALL SELECT 'invalid_date_count',
      CAST(sum(CASE WHEN detected_type = 'date' THEN invalid_count ELSE 0 END) AS BIGINT) FROM columns
    UNION ALL SELECT 'duplicate_rows', 0
    UNION ALL SELECT 'original_rows', count(*) FROM orders
    UNION ALL SELECT 'rows_delta', (SELECT count(*) FROM current) - (SELECT count(*) FROM orders)"""

_normed = f"""normed AS (
      SELECT _row, {_title(_collapse(_trim("cust_nm")))} AS cust_nm, lower(mail) AS mail, ph_no, age,
             {_null_words(f"upper({_trim('status')})")} AS status
      FROM dirty_customer)"""
_age = _number("age")
_age_bad = f"age <> '' AND (({_age}) IS NULL OR ({_age}) < 0 OR ({_age}) > 120)"
_last = "SELECT _row, cust_nm AS customer_name, mail AS email, age, status FROM"


def _flow(head: str, checked: bool = True) -> str:
    source = f"(SELECT * FROM normed WHERE NOT ({_age_bad}))" if checked else "normed"
    return f"""WITH dirty_customer AS ({head}), {_normed}
    {_last} ({_kept(source, "mail")})"""


_customers = view_sql("dirty_customer")
ORACLE["flow_demo"] = _flow(_customers)
ORACLE["flow_disabled_step"] = _flow(_customers, checked=False)
ORACLE["flow_dry_run"] = _flow(f"SELECT * FROM ({_customers}) ORDER BY _row LIMIT 200")
ORACLE["flow_order_sensitive"] = f"""{with_views("dirty_customer")}
    SELECT _row, cust_nm, mail, ph_no, age, upper({_trim("status")}) AS status
    FROM ({_kept("dirty_customer", "status")})"""
ORACLE["flow_step_report"] = f"""{with_views("dirty_customer")}, {_normed},
    checked AS (SELECT * FROM normed WHERE NOT ({_age_bad})),
    n AS (SELECT (SELECT count(*) FROM dirty_customer) AS a, (SELECT count(*) FROM checked) AS b,
                 (SELECT count(DISTINCT mail) FROM checked) AS c,
                 (SELECT count(*) FILTER (WHERE x.cust_nm <> y.cust_nm)
                       + count(*) FILTER (WHERE x.mail <> y.mail)
                       + count(*) FILTER (WHERE x.status <> coalesce(y.status, ''))
                  FROM dirty_customer x JOIN normed y USING (_row)) AS cells)
    SELECT 'norm' AS step_id, a AS input_rows, a AS output_rows, cells AS changed_cells FROM n
    UNION ALL SELECT 'check', a, b, 0 FROM n
    UNION ALL SELECT 'dedupe', b, c, 0 FROM n
    UNION ALL SELECT 'rename', c, c, 0 FROM n"""

_GUARD = r"""CASE WHEN regexp_matches({v}, '^[=+\-@\t\r]')
    AND NOT regexp_matches({v}, '^[+-]?[0-9]+(\.[0-9]+)?$') THEN '''' || {v} ELSE {v} END"""
_order_columns = _columns_of("dirty_orders")
_guarded = ", ".join(f'{_GUARD.format(v=c)} AS {c}' for c in _order_columns)
ORACLE["export_guard"] = f"SELECT _row, {_guarded} FROM ({view_sql('dirty_orders')})"
_hits = " + ".join(f"count(*) FILTER (WHERE {_GUARD.format(v=c)} <> {c})" for c in _order_columns)
ORACLE["export_guard_count"] = (
    f"SELECT {_hits} AS formula_cells_sanitized FROM ({view_sql('dirty_orders')})"
)
ORACLE["export_roundtrip_csv"] = (
    f"SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text "
    f"FROM ({view_sql('document_rows')})"
)
ORACLE["export_one_column"] = """
    SELECT coalesce(text, '') AS text FROM documents UNION ALL SELECT '' FROM documents"""
ORACLE["csv_multiline"] = """
    SELECT CAST(doc_id AS VARCHAR) AS doc_id, coalesce(replace(text, ' ', chr(10)), '') AS text, coalesce(lang, '') AS lang
    FROM documents"""
ORACLE["csv_wide_header"] = """
    SELECT repeat('the_number_of_the_orders_with_remainder_', 30) || lpad(CAST(o_orderkey % 64 AS VARCHAR), 2, '0') AS name,
           CAST(o_orderkey AS VARCHAR) AS cell
    FROM orders"""
ORACLE["inventory_files"] = """
    SELECT * FROM (VALUES
        ('semicolon', 'csv', 'text', 'UTF-8', ';', 'cust_nm/mail/ph_no/age/status', 'accepted', NULL, false),
        ('western', 'csv', 'text', 'windows-1252', chr(9), 'user/café/on_day/props', 'accepted', NULL, false),
        ('breaks', 'csv', 'text', 'UTF-8', ',', 'source/text', 'accepted', NULL,
            (SELECT bool_or(contains(text, chr(10))) FROM documents)),
        ('other', 'parquet', 'binary', NULL, NULL, NULL, 'failed', 'unsupported_file_type', false)
    ) t(folder, extension, kind, encoding, delimiter, header, status, error_code, spans_lines)"""
ORACLE["export_roundtrip_json"] = (
    f"SELECT {', '.join(_order_columns)} FROM ({view_sql('dirty_orders')})"
)
ORACLE["ingest_batch"] = """
    SELECT 'uploaded' AS status, 5 AS column_count, count(*) AS row_count FROM customer
    UNION ALL SELECT 'uploaded', 6, count(*) FROM orders
    UNION ALL SELECT 'uploaded', 3, count(*) FROM customer"""
ORACLE["csv_ragged_quarantine"] = """
    SELECT 'good' AS part, count(*) FILTER (WHERE o_orderkey % 50 <> 0) AS n FROM orders
    UNION ALL SELECT 'bad', count(*) FILTER (WHERE o_orderkey % 50 = 0) FROM orders"""

_RUN = "lpad(CAST(event_id AS VARCHAR), 12, '0')"
_NEWEST = f"ORDER BY ts DESC, {_RUN} DESC"
ORACLE["runs_last_per_kind"] = f"""
    SELECT CAST(user_id AS VARCHAR) AS dataset_id, event_type AS kind, {_RUN} AS run_id,
           '{{"row_count": ' || event_id || ', "column_count": 3}}' AS summary
    FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type {_NEWEST}) = 1"""
ORACLE["runs_history"] = f"""
    SELECT {_RUN} AS run_id, CAST(user_id AS VARCHAR) AS dataset_id
    FROM events WHERE event_type = 'click' {_NEWEST}"""
ORACLE["runs_catalog"] = f"""
    SELECT CAST(user_id AS VARCHAR) AS dataset_id, event_id AS row_count, 3 AS column_count,
           'ready' AS status
    FROM events QUALIFY row_number() OVER (PARTITION BY user_id {_NEWEST}) = 1"""
ORACLE["match_known_names"] = """
    SELECT s_name AS "table", spelling AS "column", target, CAST(confidence AS DOUBLE) AS confidence
    FROM supplier JOIN (VALUES (0, 'Cust NM', 'customer_name', 0.95), (1, 'E-Mail', 'email', 1.0),
      (2, 'Tel.', 'phone', 0.95), (3, 'order_no', 'order_id', 0.95), (4, 'Town', 'city', 0.95))
      AS t(k, spelling, target, confidence) ON s_suppkey % 6 = k"""
# Expected scores by hand: twice the matched letters over all letters, weighed by 0.9.
ORACLE["match_spellings"] = """
    SELECT s_name AS "table", spelling || CASE WHEN part THEN CAST(s_suppkey AS VARCHAR) ELSE '' END AS "column",
           target, round(CASE WHEN part THEN 0.6 ELSE 0.9 * 2 * matched / letters END, 2) AS confidence,
           CASE WHEN part THEN 'substring name match'
                ELSE printf('name similarity %.2f', 2.0 * matched / letters) END AS rationale
    FROM supplier, (VALUES ('phon', 'phone', 4, 9.0, false), ('statuss', 'status', 6, 13.0, false),
      ('customr_name', 'customer_name', 11, 23.0, false), ('countryx', 'country', 7, 15.0, false),
      ('total_paid_', 'amount', 0, 1.0, true), ('my_city_', 'city', 0, 1.0, true))
      AS t(spelling, target, matched, letters, part)"""
ORACLE["val_regex_class"] = r"""
    SELECT doc_id + 1 AS row, word AS value FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS word FROM documents)
    WHERE word <> '' AND NOT regexp_full_match(word, '[A-Za-z&\[.,]+s?')"""
_KNOWN = ", ".join(
    f"({place}, '{target}', '{plain}', {EXACT if i == 0 else SYNONYM})"
    for place, target in enumerate(TARGETS)
    for i, plain in enumerate(plain_name(n) for n in [target, *SYNONYMS[target]])
)
_LETTER_COUNTS = (
    "list_transform(string_split('abcdefghijklmnopqrstuvwxyz0123456789', ''), lambda c: len({v}) - len(replace({v}, c, '')))"
)
# A block as one number: its size, then the earlier place in ``a`` first.
_BLOCK = (
    "list_max(flatten(list_transform(range(1, len(a) + 1), lambda i: list_transform(range(1, len(a) - i + 2), "
    "lambda n: CASE WHEN contains(b, substr(a, i, n)) THEN n * 10000 + 9999 - i END))))"
)
ORACLE["match_columns"] = rf"""
    WITH RECURSIVE known(place, target, name, score) AS (VALUES {_KNOWN}
    ), words AS (
        SELECT DISTINCT 'documents' AS "table", unnest(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}_]+')) AS "column" FROM documents
        UNION SELECT 'part', unnest(regexp_split_to_array(lower(p_name), '[^\p{{L}}\p{{N}}_]+')) FROM part
    ), named AS (
        SELECT *, regexp_replace(lower("column"), '[^a-z0-9]+', '', 'g') AS plain FROM words WHERE "column" <> ''
    ), direct AS (
        SELECT name AS plain, target, score,
               CASE score WHEN 1.0 THEN 'exact name match' ELSE concat('known synonym of ', chr(39), target, chr(39)) END AS rationale
        FROM known QUALIFY row_number() OVER (PARTITION BY name ORDER BY score DESC, place) = 1
    ), rest AS (
        SELECT plain, {_LETTER_COUNTS.format(v="plain")} AS counts
        FROM (SELECT DISTINCT plain FROM named WHERE plain NOT IN (SELECT name FROM known))
    ), candidates AS (SELECT *, {_LETTER_COUNTS.format(v="name")} AS counts FROM known
    ), pairs AS (
        SELECT rest.plain, place, target, name, row_number() OVER () AS pair
        FROM rest JOIN candidates ON 8 * least(len(plain), len(name)) >= 3 * (len(plain) + len(name))
        WHERE 8 * list_sum(list_transform(range(1, 37), lambda i: least(rest.counts[i], candidates.counts[i]))) >= 3 * (len(plain) + len(name))
    ), blocks AS (
        SELECT pair, a, b, {_BLOCK} AS best FROM (SELECT pair, plain AS a, name AS b FROM pairs)
        UNION ALL
        SELECT pair, a, b, {_BLOCK} FROM (
            SELECT pair, unnest([substr(a, 1, i - 1), substr(a, i + n)]) AS a, unnest([substr(b, 1, j - 1), substr(b, j + n)]) AS b
            FROM (SELECT pair, a, b, i, n, instr(b, substr(a, i, n)) AS j
                  FROM (SELECT pair, a, b, 9999 - best % 10000 AS i, best // 10000 AS n FROM blocks WHERE best IS NOT NULL))
        ) WHERE a <> '' AND b <> ''
    ), near AS (
        SELECT plain, target, 2.0 * matched / (len(plain) + len(name)) AS near
        FROM pairs JOIN (SELECT pair, sum(best // 10000) AS matched FROM blocks GROUP BY 1) USING (pair)
        WHERE 8 * matched >= 3 * (len(plain) + len(name))
        QUALIFY row_number() OVER (PARTITION BY plain ORDER BY near DESC, place) = 1
    ), parts AS (
        SELECT plain, target FROM rest JOIN known ON len(name) >= 4 AND (contains(plain, name) OR contains(name, plain))
        QUALIFY row_number() OVER (PARTITION BY plain ORDER BY place) = 1
    ), scored AS (
        SELECT * FROM direct
        UNION ALL SELECT plain, target, near * 0.9, printf('name similarity %.2f', near) FROM near
        UNION ALL SELECT plain, target, 0.6, 'substring name match' FROM parts WHERE plain NOT IN (SELECT plain FROM near)
    )
    SELECT "table", "column", target, round(CAST(score AS DOUBLE), 2) AS confidence, rationale, 'heuristic' AS provider
    FROM named JOIN scored USING (plain)"""
ORACLE["val_allowed_large"] = f"""
    SELECT 'allowed_values' AS rule, _row + 1 AS row, order_id AS value, 'value is not in the allowed set' AS reason
    FROM ({view_sql('dirty_orders')}) WHERE CAST(order_id AS BIGINT) % 2 = 1 OR CAST(order_id AS BIGINT) >= 200000"""
