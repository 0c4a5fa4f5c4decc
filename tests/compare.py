"""Compares a Spark query with its SQL in DuckDB, as multisets of rows."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        source = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{source}'")
    return con


def cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else "inf" if v == math.inf else "-inf" if v == -math.inf else round(v, 9) + 0.0
    if isinstance(v, dict):
        return tuple(sorted((k, cell(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return cell(v.asDict())
    if isinstance(v, (list, tuple)):
        return tuple(cell(x) for x in v)
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(cell(r[i]) for i in order) for r in rows), key=repr)


def differences(df, sql: str, sf_dir: str) -> list[str]:
    con = connect(sf_dir)
    got_names, got = df.columns, [tuple(r) for r in df.collect()]
    cur = con.execute(sql)
    want_names = [d[0] for d in cur.description]
    want = cur.fetchall()
    out = []
    if sorted(got_names) != sorted(want_names):
        return [f"columns {sorted(got_names)} and {sorted(want_names)}"]
    a, b = rows_of(got_names, got), rows_of(want_names, want)
    if len(a) != len(b):
        out.append(f"{len(a)} and {len(b)} rows")
    out += [f"{x} and {y}" for x, y in zip(a, b) if repr(x) != repr(y)][:3]
    return out
