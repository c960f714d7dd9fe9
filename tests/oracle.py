"""Compare a registered query with its SQL twin row by row."""

from __future__ import annotations

import math
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _value(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6)
    if isinstance(x, (list, tuple)):
        return tuple(_value(v) for v in x)
    return x


def difference(spark, con, query, sql: str, sf_dir: str) -> str:
    """Empty when columns and rows agree, else a short description."""
    left = query(spark, sf_dir)
    columns = sorted(left.columns)
    rows = [tuple(_value(r[c]) for c in columns) for r in left.collect()]
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    if sorted(names) != columns:
        return f"columns {columns} vs {sorted(names)}"
    at = [names.index(c) for c in columns]
    expected = [tuple(_value(r[i]) for i in at) for r in cursor.fetchall()]
    if not rows:
        return "no rows"
    a, b = Counter(rows), Counter(expected)
    if a == b:
        return ""
    return f"{len(rows)} vs {len(expected)} rows; only spark {list((a - b))[:2]}; only sql {list((b - a))[:2]}"
