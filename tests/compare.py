"""Run a registered query and its SQL on the same tables and compare the values."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def database(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{folder}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "NaN" if math.isnan(value) else 0.0 if value == 0 else float(f"{value:.9g}")
    if isinstance(value, (list, tuple)):
        return tuple(map(_plain, value))
    if value is not None and type(value).__name__ == "Decimal":
        return float(value)
    return value


def _sorted(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    rows = [tuple(_plain(r[i]) for i in order) for r in records]
    return [columns[i] for i in order], sorted(rows, key=repr)


def difference(df, con, sql: str) -> str | None:
    """None when both sides agree, else the first difference."""
    found = con.execute(sql)
    want_cols, want = _sorted([d[0] for d in found.description], found.fetchall())
    types = {d[0]: str(d[1]) for d in found.description}
    have_cols, have = _sorted(df.columns, [tuple(r) for r in df.collect()])
    if have_cols != want_cols:
        return f"columns {have_cols} != {want_cols}"
    kinds = {"string": "VARCHAR", "bigint": "BIGINT", "double": "DOUBLE", "int": "INTEGER", "boolean": "BOOLEAN"}
    odd = [f"{c}:{t}/{types[c]}" for c, t in df.dtypes if t in kinds and kinds[t] != types[c]]
    if odd:
        return f"types {odd}"
    if len(have) != len(want):
        return f"rows {len(have)} != {len(want)}; first {have[:2]} / {want[:2]}"
    for a, b in zip(have, want):
        if a != b:
            return f"{have_cols}: {a} != {b}"
    return None
