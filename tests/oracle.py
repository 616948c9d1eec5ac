"""Runs a query's SQL in DuckDB and compares rows as sorted tuples."""

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _cell(x):
    if x is None or x is pd.NaT or (isinstance(x, float) and x != x):
        return "~"
    if isinstance(x, bool):
        return str(x)
    try:
        return repr(round(float(x), 6) + 0.0)
    except (TypeError, ValueError):
        return str(x)


def canonical(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(map(_cell, row)) for row in frame.itertuples(index=False, name=None))


def run_sql(sf_dir: str, text: str) -> pd.DataFrame:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con.execute(text).fetchdf()
