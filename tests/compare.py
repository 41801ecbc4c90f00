"""Spark results against DuckDB's on the same tables."""

from __future__ import annotations

import math

import duckdb
import pyarrow as pa

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def kind(t: pa.DataType) -> str:
    """Type by what it holds; large and small variants of one are alike."""
    if pa.types.is_string(t) or pa.types.is_large_string(t):
        return "string"
    if pa.types.is_list(t) or pa.types.is_large_list(t):
        return f"list<{kind(t.value_type)}>"
    return str(t)


def run_sql(sf_dir: str, sql: str) -> pa.Table:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con.sql(sql).to_arrow_table()


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9) + 0.0
    if isinstance(v, list):
        return tuple(map(_plain, v))
    return v


def rows(table: pa.Table) -> list[tuple]:
    names = sorted(table.column_names)
    columns = [[_plain(v) for v in table.column(n).to_pylist()] for n in names]
    return sorted(zip(*columns, strict=True), key=repr)


def differences(mine: pa.Table, theirs: pa.Table) -> str:
    """What differs: columns, types or rows; nothing if all agree."""
    a, b = ({f.name: kind(f.type) for f in t.schema} for t in (mine, theirs))
    if a != b:
        return f"schema {set(a.items()) ^ set(b.items())}"
    x, y = rows(mine), rows(theirs)
    if len(x) != len(y):
        return f"{len(x)} and {len(y)} rows"
    odd = [(p, q) for p, q in zip(x, y, strict=True) if p != q]
    return f"{len(odd)} rows, such as {odd[:2]}" if odd else ""
