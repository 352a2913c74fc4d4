"""Run a registered query in Spark and its SQL in DuckDB and compare the values."""

from __future__ import annotations

import math

import duckdb
import pandas as pd

from newsloom.fixtures import BASE_TABLES


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for name in BASE_TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def _cell(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return None
    if hasattr(v, "item") and not isinstance(v, pd.Timestamp):
        v = v.item()
    if isinstance(v, float):
        return f"{v:.6g}"
    if isinstance(v, bool):
        return v
    if isinstance(v, int):
        return str(v)
    return str(v)


def rows_of(pdf: pd.DataFrame) -> tuple[list[str], list[tuple]]:
    columns = sorted(pdf.columns)
    rows = [tuple(_cell(v) for v in row) for row in pdf[columns].itertuples(index=False, name=None)]
    return columns, sorted(rows, key=repr)


def differences(spark_pdf: pd.DataFrame, duck_pdf: pd.DataFrame) -> str | None:
    """None if equal, else a short account of what differs."""
    cols_a, a = rows_of(spark_pdf)
    cols_b, b = rows_of(duck_pdf)
    if cols_a != cols_b:
        return f"columns {cols_a} != {cols_b}"
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}"
    for x, y in zip(a, b):
        if x != y:
            bad = [(c, str(u)[:120], str(v)[:120]) for c, u, v in zip(cols_a, x, y) if u != v]
            return f"first difference {bad}"
    return None
