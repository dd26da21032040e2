"""Comparison of a query's rows with its SQL twin's in DuckDB."""

import glob
import os

import duckdb


def tables(sf: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def shown(value) -> str:
    if isinstance(value, float):
        return repr(round(value, 6))
    return repr(value)


def same_rows(df, con, sql: str) -> None:
    columns = sorted(df.columns)
    got = sorted(tuple(shown(r[c]) for c in columns) for r in df.collect())
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = sorted(tuple(shown(row[names.index(c)]) for c in columns) for row in result.fetchall())
    assert got == want
