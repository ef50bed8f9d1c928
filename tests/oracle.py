"""Comparing a query's rows with those of its SQL."""

from __future__ import annotations

import math

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf}/{name}.parquet')")
    return con


def _cell(value):
    if value is None or value is pd.NaT or value is pd.NA or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, float):
        return round(value, 6)
    if hasattr(value, "item"):
        return _cell(value.item())
    return value


def rows_of(frame: pd.DataFrame) -> list[tuple]:
    """Rows with columns by name, in an order of their own."""
    frame = frame[sorted(frame.columns)]
    rows = [tuple(_cell(v) for v in row) for row in frame.itertuples(index=False, name=None)]
    return sorted(rows, key=lambda r: tuple((v is None, str(v)) for v in r))


def difference(spark_frame: pd.DataFrame, sql_frame: pd.DataFrame) -> str | None:
    """What is different, or None."""
    if sorted(spark_frame.columns) != sorted(sql_frame.columns):
        return f"columns {sorted(spark_frame.columns)} / {sorted(sql_frame.columns)}"
    if len(spark_frame) != len(sql_frame):
        return f"rows {len(spark_frame)} / {len(sql_frame)}"
    for left, right in zip(rows_of(spark_frame), rows_of(sql_frame), strict=True):
        if left != right:
            return f"row {left} / {right}"
    kinds = [(c, spark_frame[c].dtype.kind, sql_frame[c].dtype.kind) for c in sorted(spark_frame.columns)]
    odd = [k for k in kinds if {k[1], k[2]} in ({"i", "f"}, {"i", "O"}, {"b", "O"}, {"f", "O"})]
    return f"types {odd}" if odd and len(spark_frame) else None
