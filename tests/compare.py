"""Rows of Spark and DuckDB in one comparable form."""

import math

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _value(v):
    if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, float):
        return round(v, 6)
    if hasattr(v, "year"):
        return str(pd.Timestamp(v))
    if isinstance(v, (bool, int)) or hasattr(v, "dtype"):
        return round(float(v), 6) if float(v) != int(v) else int(v)
    return str(v)


def rows(frame: pd.DataFrame):
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted((tuple(_value(v) for v in r) for r in frame.itertuples(index=False)), key=str)
