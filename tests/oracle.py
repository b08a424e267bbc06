"""Hold a query against its SQL in DuckDB, as multisets of rows."""

from __future__ import annotations

import os

import duckdb
import pandas as pd

from plumbline.sources import TABLES

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def connect(sf_dir: str = DATA) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def _norm(df: pd.DataFrame) -> list[tuple]:
    def cell(v):
        if hasattr(v, "tolist"):
            v = v.tolist()
        if isinstance(v, list):
            return repr([cell(x) for x in v])
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
            return "null"
        if isinstance(v, float):
            return repr(round(v, 9) + 0.0)
        return str(v) if isinstance(v, bool) else repr(float(v)) if isinstance(v, int) else str(v)

    return sorted(tuple(cell(v) for v in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


def difference(spark, query, sql: str, sf_dir: str = DATA) -> str | None:
    """None if they agree, else what differs first."""
    a, b = query(spark, sf_dir).toPandas(), connect(sf_dir).execute(sql).df()
    if sorted(a.columns) != sorted(b.columns):
        return f"columns {sorted(a.columns)} and {sorted(b.columns)}"
    x, y = _norm(a), _norm(b)
    if x == y:
        return None
    a, b = set(x), set(y)
    only = [r for r in x if r not in b][:3], [r for r in y if r not in a][:3]
    return f"{len(x)} and {len(y)} rows; only in one: {only}"
