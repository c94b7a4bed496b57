"""Holds a query's rows against its DuckDB SQL."""

from __future__ import annotations

import math
import os
from collections import Counter
from pathlib import Path

import duckdb

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str = SF_DIR) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        path = Path(sf_dir, f"{name}.parquet")
        if path.exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}{'/*.parquet' if path.is_dir() else ''}'")
    return con


def plain(x: object) -> object:
    """A value that compares equal across engines; doubles by ten digits."""
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.10g}")
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    return x


def rows_of(names: list[str], rows: list[tuple]) -> Counter:
    at = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(plain(r[i]) for i in at) for r in rows)


def difference(spark, query, sql: str, sf_dir: str = SF_DIR) -> str:
    """Empty if both give the same columns and rows."""
    df = query(spark, sf_dir)
    ours, con = rows_of(df.columns, [tuple(r) for r in df.collect()]), connect(sf_dir)
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    theirs = rows_of(names, found.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    if ours != theirs:
        return f"{sum(ours.values())} and {sum(theirs.values())} rows; only here {list((ours - theirs).items())[:2]}; only there {list((theirs - ours).items())[:2]}"
    return ""
