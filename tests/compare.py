"""Spark results against DuckDB on the same tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def normal(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 4) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(normal, v))
    return v


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(normal(r[i]) for i in order) for r in rows), key=repr)


def differences(con, df, sql: str) -> str:
    """Empty if both give the same columns and rows."""
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    want, got = rows_of(names, cursor.fetchall()), rows_of(df.columns, [tuple(r) for r in df.collect()])
    if want == got:
        return ""
    odd = [(g, w) for g, w in zip(got, want, strict=False) if g != w]
    return f"{len(got)} and {len(want)} rows; first odd {odd[:1]}"
