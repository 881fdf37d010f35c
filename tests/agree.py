"""Compares a query with its SQL, order of rows aside."""

from __future__ import annotations

import glob
import os

import duckdb
import pandas as pd


def rows(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]

    def plain(v: object) -> str | None:
        if v is None or v is pd.NA or (isinstance(v, float) and v != v):
            return None
        if isinstance(v, float) and v == int(v):
            return str(int(v))
        return repr(round(v, 8)) if isinstance(v, float) else str(v)

    out = [tuple(plain(v) for v in r) for r in df.astype(object).where(df.notna(), None).values.tolist()]
    return sorted(out, key=lambda r: tuple((x is None, x or "") for x in r))


def by_sql(sf_dir: str, sql: str) -> pd.DataFrame:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con.sql(sql).df()


def same(spark, sf_dir: str, query, sql: str) -> None:
    found, wanted = query(spark, sf_dir).toPandas(), by_sql(sf_dir, sql)
    assert sorted(found.columns) == sorted(wanted.columns)
    assert rows(found) == rows(wanted)
