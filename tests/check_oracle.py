"""Compare every query with its SQL oracle: python tests/check_oracle.py [sf_dir] [name …]."""

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry
from tablescour.session import local_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def canonical_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    def cell(v):
        if isinstance(v, float):
            return f"{v:.9g}"
        return "∅" if v is None else str(v)
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def connect(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def compare(spark, con, name, sf_dir):
    """None when equal, else a message; rows only where there is no oracle."""
    df = entry.queries()[name](spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return None if got else "no rows"
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    want = cursor.fetchall()
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(columns)}"
    a, b = canonical_rows(df.columns, got), canonical_rows(columns, want)
    if a != b:
        only_a = [r for r in a if r not in set(b)][:3]
        only_b = [r for r in b if r not in set(a)][:3]
        return f"{len(a)} vs {len(b)} rows; spark only {only_a}; sql only {only_b}"
    return None


if __name__ == "__main__":
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(entry.queries())
    session = local_session(8)
    session.sparkContext.setLogLevel("ERROR")
    con, failed = connect(folder), 0
    for name in names:
        start = time.time()
        try:
            problem = compare(session, con, name, folder)
        except Exception as error:
            problem = f"{type(error).__name__}: {str(error)[:300]}"
        failed += problem is not None
        print(f"CHECK {name} {'ok' if problem is None else 'FAIL ' + problem[:500]} {time.time() - start:.1f}s", flush=True)
    print(f"CHECK {len(names) - failed} of {len(names)} equal")
