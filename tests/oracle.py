"""Compares a query with its DuckDB SQL over one folder of tables."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return c


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    if hasattr(value, "normalize"):  # decimals
        return round(float(value), 6) + 0.0
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def differences(df, sql: str, connection) -> list[str]:
    """What differs; empty if rows and columns agree."""
    found = connection.execute(sql)
    want_names, want = rows_of([x[0] for x in found.description], found.fetchall())
    names, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    out = [f"columns {names} != {want_names}"] if names != want_names else []
    out += [f"{len(got)} rows != {len(want)}"] if len(got) != len(want) else []
    return out + [f"{a} != {b}" for a, b in zip(got, want, strict=False) if repr(a) != repr(b) and [float(x) if isinstance(x, int) and not isinstance(x, bool) else x for x in a] != [float(x) if isinstance(x, int) and not isinstance(x, bool) else x for x in b]][:3]
