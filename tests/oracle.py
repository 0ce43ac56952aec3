"""Compares a query's rows with DuckDB's, in any order."""

import os

import duckdb

from sequora.session import TABLES


def connect(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/*.parquet'" if os.path.isdir(path) else f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    return con


def _plain(x):
    if isinstance(x, float):
        return "nan" if x != x else f"{x:.6g}"
    return str(x)


def same(df, con, sql) -> None:
    rows = [tuple(r) for r in df.collect()]
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    want = result.fetchall()
    assert sorted(names) == sorted(df.columns)
    place = [names.index(c) for c in df.columns]
    got = sorted(tuple(map(_plain, r)) for r in rows)
    assert got == sorted(tuple(_plain(r[i]) for i in place) for r in want)
