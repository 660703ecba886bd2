"""Compares a query with its SQL in DuckDB, whatever the order of rows and columns."""

import datetime
import math
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _cell(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6) + 0.0
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    return x


def mismatch(spark, query, sql, sf_dir):
    """None if equal, else what differs."""
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = con.sql(sql)
    df = query(spark, sf_dir)
    names, got_names = sorted(want.columns), sorted(df.columns)
    if names != got_names:
        return f"columns {got_names}, expected {names}"
    kinds = {c: str(k) for c, k in zip(want.columns, want.types)}
    same = {"VARCHAR": "string", "BIGINT": "bigint", "DOUBLE": "double", "BOOLEAN": "boolean", "INTEGER": "int", "TIMESTAMP": "timestamp_ntz", '"NULL"': "string"}
    wrong = {c: (dict(df.dtypes)[c], kinds[c]) for c in names if same.get(kinds[c], kinds[c]) != dict(df.dtypes)[c]}
    at = [want.columns.index(c) for c in names]
    expected = Counter(tuple(_cell(r[i]) for i in at) for r in want.fetchall())
    found = Counter(tuple(_cell(r[c]) for c in names) for r in df.collect())
    if found != expected:
        return f"{sum(found.values())} rows, expected {sum(expected.values())}; only here {list((found - expected).items())[:3]}; missing {list((expected - found).items())[:3]}"
    return f"types {wrong}" if wrong else None
