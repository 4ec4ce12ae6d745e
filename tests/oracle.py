"""Comparison of a Spark result with DuckDB SQL over the same Parquet tables."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        files = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{files}')")
    return con


def plain(x):
    """A value as both engines agree on it."""
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(x, (list, tuple)):
        return [plain(v) for v in x]
    if hasattr(x, "as_tuple"):
        return float(x)
    return x


def rows(columns: list[str], values) -> list:
    by = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([plain(v[i]) for i in by] for v in values), key=repr)


def assert_same(df, con, sql: str) -> int:
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    want = rows(names, found.fetchall())
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    assert sorted(df.columns) == sorted(names)
    assert len(got) == len(want), (len(got), len(want))
    for g, w in zip(got, want, strict=True):
        assert g == w
    return len(got)
