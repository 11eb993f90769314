"""Order-free comparison of a Spark result with DuckDB's answer on the same files."""

from __future__ import annotations

import datetime as dt
import decimal
import math

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


def answer(connection, sql: str) -> pd.DataFrame:
    """A statement's rows as Python values, so that decimals stay exact."""
    found = connection.execute(sql)
    return pd.DataFrame(found.fetchall(), columns=[c[0] for c in found.description], dtype=object)


def plain(x):
    if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and math.isnan(x)):
        return None
    if isinstance(x, bool) or type(x).__name__ == "bool_":
        return bool(x)
    if hasattr(x, "item"):
        x = x.item()
    if isinstance(x, (int, decimal.Decimal)):  # exactly; 5 and 5.00 are the same number
        return str(decimal.Decimal(x).normalize() + 0)
    if isinstance(x, float):  # a column with gaps comes as floats from either side
        return str(decimal.Decimal(int(x))) if x == int(x) and abs(x) < 2**53 else round(x, 6)
    if isinstance(x, dt.date) and not isinstance(x, dt.datetime):
        return str(pd.Timestamp(x))
    if isinstance(x, dt.datetime):
        return str(pd.Timestamp(x))
    return x


def rows(frame: pd.DataFrame, columns: list[str]) -> list[str]:
    return sorted(str([plain(v) for v in r]) for r in frame[columns].astype(object).values.tolist())


def differences(spark_frame: pd.DataFrame, oracle: pd.DataFrame) -> str:
    columns = sorted(spark_frame.columns)
    if columns != sorted(oracle.columns):
        return f"columns {columns} against {sorted(oracle.columns)}"
    a, b = rows(spark_frame, columns), rows(oracle, columns)
    if a == b:
        return ""
    return f"{len(a)} rows against {len(b)}; first difference {next(((x, y) for x, y in zip(a, b) if x != y), 'in number')}"
