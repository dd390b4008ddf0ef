"""Runs a query on Spark and its SQL on DuckDB, and compares the rows."""

from __future__ import annotations

import math

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    from pathlib import Path

    db = duckdb.connect()
    for t in TABLES:
        path = Path(f"{sf_dir}/{t}.parquet")
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/*.parquet'" if path.is_dir() else f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    return db


def plain(v):
    if v is None or v is pd.NaT or isinstance(v, float) and math.isnan(v):
        return None
    if hasattr(v, "item"):
        v = v.item()
    return int(v) if isinstance(v, float) and v.is_integer() else v


def rows(pdf: pd.DataFrame) -> list[tuple]:
    names = sorted(pdf.columns)
    return sorted((tuple(plain(v) for v in r) for r in pdf[names].astype(object).itertuples(index=False)), key=repr)


def difference(spark, db, f, sql: str, sf_dir: str) -> str:
    """What differs, or an empty string."""
    got, want = f(spark, sf_dir).toPandas(), db.execute(sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} and {sorted(want.columns)}"
    a, b = rows(got), rows(want)
    if len(a) != len(b):
        return f"{len(a)} and {len(b)} rows"
    bad = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    return f"{len(bad)} of {len(a)} rows, as {bad[0]}" if bad else ""
