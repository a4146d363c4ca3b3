"""Messy tables derived from the test tables, written once for Spark and for SQL oracles.

Each view is a base table and one expression per column. ``{S}`` is the engine's string
type and ``day(column, format)`` its date formatting; all else is common SQL.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_SPARK_FORMATS = {
    "%Y-%m-%d": "yyyy-MM-dd",
    "%m/%d/%Y": "MM/dd/yyyy",
    "%b %d, %Y": "MMM dd, yyyy",
    "%d %B %Y": "dd MMMM yyyy",
    "%Y.%m.%d": "yyyy.MM.dd",
}

# About a third of the customers share the empty mail: the hot key of the dedupes.
VIEWS: dict[str, tuple[str, dict[str, str]]] = {
    "dirty_customer": (
        "customer",
        {
            "_row": "c_custkey",
            "cust_nm": """CASE c_custkey % 4
                WHEN 0 THEN '  ' || lower(c_mktsegment) || '   mac-' || lower(c_name) || ' '
                WHEN 1 THEN upper(c_name) || chr(9) || '3rd'
                WHEN 2 THEN c_name ELSE c_name || ' ' END""",
            "mail": """CASE WHEN c_custkey % 3 = 0 THEN ''
                WHEN c_custkey % 10 = 0 THEN 'bad-' || CAST(c_custkey AS {S})
                ELSE lower(c_mktsegment) || CAST(c_custkey % 60 AS {S}) || '@example.com' END""",
            "ph_no": """CASE c_custkey % 4
                WHEN 0 THEN '+1 (555) ' || lpad(CAST(c_custkey AS {S}), 7, '0')
                WHEN 1 THEN '555.' || lpad(CAST(c_custkey AS {S}), 7, '0')
                WHEN 2 THEN '555/' || lpad(CAST(c_custkey AS {S}), 7, '0') || ' x'
                ELSE '' END""",
            "age": """CASE WHEN c_custkey % 31 = 0 THEN 'abc'
                WHEN c_custkey % 37 = 0 THEN ''
                WHEN c_custkey % 41 = 0 THEN ' 1e2 '
                ELSE CAST(c_custkey % 150 - 5 AS {S}) END""",
            "status": """CASE WHEN c_custkey % 13 = 0 THEN ' N/A'
                WHEN c_custkey % 17 = 0 THEN '-'
                WHEN c_custkey % 3 = 1 THEN ' ' || lower(c_mktsegment) || '  '
                ELSE c_mktsegment END""",
        },
    ),
    "dirty_orders": (
        "orders",
        {
            "_row": "o_orderkey",
            "order_id": "CAST(o_orderkey AS {S})",
            "cust_id": "CAST(o_custkey AS {S})",
            "order_date": """CASE WHEN o_orderkey % 97 = 0 THEN 'not-a-date'
                WHEN o_orderkey % 41 = 0 THEN ''
                WHEN o_orderkey % 5 = 0 THEN day(o_orderdate, %Y-%m-%d)
                WHEN o_orderkey % 5 = 1 THEN day(o_orderdate, %m/%d/%Y)
                WHEN o_orderkey % 5 = 2 THEN day(o_orderdate, %b %d, %Y)
                WHEN o_orderkey % 5 = 3 THEN day(o_orderdate, %d %B %Y)
                ELSE day(o_orderdate, %Y.%m.%d) END""",
            "amount": """CASE WHEN o_orderkey % 29 = 0 THEN 'free'
                WHEN o_orderkey % 31 = 0 THEN '-' || CAST(CAST(o_totalprice AS DECIMAL(12, 2)) AS {S})
                WHEN o_orderkey % 37 = 0 THEN '=' || CAST(CAST(o_totalprice AS DECIMAL(12, 2)) AS {S})
                ELSE CAST(CAST(o_totalprice AS DECIMAL(12, 2)) AS {S}) END""",
            "order_status": "CASE WHEN o_orderkey % 11 = 0 THEN lower(o_orderstatus) ELSE o_orderstatus END",
            "priority": "CASE WHEN o_orderkey % 19 = 0 THEN '@' || o_orderpriority ELSE o_orderpriority END",
        },
    ),
    # Extracts of the same customers by another team: other names, one more column.
    "new_batch": (
        "customer",
        {
            "_row": "c_custkey",
            "client": "c_name",
            "mail": "lower(c_mktsegment) || CAST(c_custkey % 60 AS {S}) || '@example.com'",
            "region": "'R' || CAST(c_nationkey AS {S})",
        },
    ),
    # Lines of an order, with few distinct rows: exact duplicates.
    "line_flags": (
        "lineitem",
        {
            "flag": "l_returnflag || l_linestatus",
            "qty": "CAST(CAST(l_quantity AS INT) AS {S})",
            "disc": "CASE WHEN l_tax = 0 THEN '' ELSE CAST(CAST(l_discount * 100 AS INT) AS {S}) END",
        },
    ),
    "event_rows": (
        "events",
        {
            "_row": "event_id",
            "user": "CAST(user_id AS {S})",
            "kind": "event_type",
            "on_day": "day(ts, %Y-%m-%d)",
            "props": "props",
        },
    ),
    "document_rows": (
        "documents",
        {"_row": "doc_id", "lang": "lang", "source": "source", "text": "text"},
    ),
    "turn_rows": (
        "conversations",
        {"_row": "conv_id * 4294967296 + turn", "role": "role", "text": "text"},
    ),
}


def _expression(sql: str, engine: str) -> str:
    def day(match: re.Match) -> str:
        column, fmt = match.group(1), match.group(2)
        if engine == "spark":
            return f"date_format({column}, '{_SPARK_FORMATS[fmt]}')"
        return f"strftime({column}, '{fmt}')"

    out = re.sub(r"day\((\w+), ([^)]*)\)", day, sql)
    return out.replace("{S}", "STRING" if engine == "spark" else "VARCHAR")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    base, columns = VIEWS[name]
    exprs = [f"{_expression(sql, 'spark')} AS `{alias}`" for alias, sql in columns.items()]
    return table(spark, sf_dir, base).selectExpr(*exprs)


def view_sql(name: str) -> str:
    base, columns = VIEWS[name]
    exprs = ", ".join(f'{_expression(sql, "sql")} AS "{alias}"' for alias, sql in columns.items())
    return f"SELECT {exprs} FROM {base}"


def with_views(*names: str) -> str:
    """A WITH clause that defines the views; more CTEs may follow after a comma."""
    return "WITH " + ", ".join(f"{n} AS ({view_sql(n)})" for n in names)
