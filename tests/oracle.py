"""Compare registered queries with their SQL: names, types, row count and values.

``python -m tests.oracle [folder] [query ...]``
"""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET max_temp_directory_size = '4GB'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "~"
    if isinstance(v, float):
        return repr(round(v, 6))
    return str(v)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


SAME = {"VARCHAR": "string", "BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double",
        "TIMESTAMP": "timestamp_ntz", "DATE": "date",
        "TINYINT": "tinyint"}


def compare(spark, con, name, query, sql, folder):
    """None when both agree, else what differs."""
    df = query(spark, folder)
    got = df.collect()
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    types = {d[0]: SAME.get(str(d[1]), str(d[1])) for d in res.description}
    want = res.fetchall()
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(set(df.columns) ^ set(names))}"
    spark_types = dict(df.dtypes)
    off = {n: (spark_types[n], types[n]) for n in names if spark_types[n] != types[n]}
    if off:
        return f"types {off}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    a, b = _rows(df.columns, got), _rows(names, want)
    if a != b:
        return f"values, e.g. {next((x, y) for x, y in zip(a, b) if x != y)}"
    return None if got else "no rows"


if __name__ == "__main__":
    import __spark_entry__ as entry
    from stratafill.session import local_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark, con = local_session(), connect(folder)
    oracles = entry.oracle_sql()
    for name, query in entry.queries().items():
        if name not in oracles or (sys.argv[2:] and name not in sys.argv[2:]):
            continue
        start = time.time()
        try:
            found = compare(spark, con, name, query, oracles[name], folder)
        except Exception as e:  # report and go on with the next query
            found = f"error {str(e)[:1500]}"
        print(f"{name:28s} {time.time() - start:6.2f}s {'ok' if found is None else found}",
              flush=True)
