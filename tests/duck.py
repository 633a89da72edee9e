"""Comparison of a query with its SQL, run by DuckDB on the same tables."""

import math
import os

import duckdb


def connection(sf_dir: str):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        path = f"{sf_dir}/{name}"
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def rows(columns, table) -> list:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    fix = lambda x: None if x is None or (isinstance(x, float) and math.isnan(x)) else round(x, 6) if isinstance(x, float) else x
    return sorted(repr([fix(r[i]) for i in order]) for r in table)


def same(df, sql: str, sf_dir: str) -> None:
    got = df.collect()
    result = connection(sf_dir).execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    assert rows(df.columns, got) == rows(names, result.fetchall())
