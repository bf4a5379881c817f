"""Holds queries against their SQL on DuckDB."""

import glob
import os

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        pattern = f"{f}/*.parquet" if os.path.isdir(f) else f
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{pattern}')")
    return con


def rows(frame):
    show = lambda x: repr(round(x, 6)) if isinstance(x, float) else repr(x.tolist() if hasattr(x, "tolist") else x)
    columns = sorted(frame.columns)
    return columns, sorted(tuple(map(show, r)) for r in frame[columns].itertuples(index=False))
