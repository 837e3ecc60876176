"""Run a registered query and its SQL over the same tables and compare the rows."""

from __future__ import annotations

import glob
import os

import duckdb
import pandas as pd


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def rows(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    clean = [tuple(None if pd.isna(v) else (v.item() if hasattr(v, "item") else v) for v in r) for r in df.itertuples(index=False)]
    return sorted(clean, key=lambda r: tuple((v is not None, str(type(v)), v) if not isinstance(v, (int, float, bool)) else (True, "n", float(v)) for v in r))


def compare(got: pd.DataFrame, want: pd.DataFrame) -> str:
    """Empty if equal, else what differs."""
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} and {sorted(want.columns)}"
    a, b = rows(got), rows(want)
    if len(a) != len(b):
        return f"{len(a)} and {len(b)} rows"
    bad = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    return f"{len(bad)} rows differ, first {bad[0]}" if bad else ""
