"""Runs a registered query and its SQL on the same tables and compares the rows."""

from __future__ import annotations

import math
import os

import duckdb

SMALL = os.environ.get("LEXLOOM_TEST_DATA", "/root/testdata/sf0.01")


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for f in sorted(os.listdir(sf_dir)):
        path = f"{sf_dir}/{f}" + ("/*.parquet" if os.path.isdir(f"{sf_dir}/{f}") else "")
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(x, dict):
        return tuple((k, _plain(v)) for k, v in sorted(x.items()))
    if hasattr(x, "asDict"):
        return _plain(x.asDict())
    if isinstance(x, (list, tuple)):
        return tuple(map(_plain, x))
    return x


def rows(columns: list[str], data) -> list[tuple]:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(_plain(r[i]) for i in order) for r in data), key=repr)


def compare(spark, name: str, query, sql: str, sf_dir: str = SMALL) -> int:
    """The number of rows; fails where the two differ."""
    df = query(spark, sf_dir)
    got = rows(df.columns, df.collect())
    rel = connect(sf_dir).sql(sql)
    want = rows(list(rel.columns), rel.fetchall())
    assert sorted(df.columns) == sorted(rel.columns), f"{name}: {df.columns} against {rel.columns}"
    assert len(got) == len(want), f"{name}: {len(got)} rows against {len(want)}; {[x for x in got if x not in want][:3]} {[x for x in want if x not in got][:3]}"
    for a, b in zip(got, want, strict=True):
        assert a == b, f"{name}: {a} against {b}"
    return len(got)
