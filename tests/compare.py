"""Rows of a query and of its DuckDB equivalent, in an order of their own, for comparison."""

import glob
from pathlib import Path

import duckdb


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([round(r[i], 6) if isinstance(r[i], float) else r[i] for i in order]) for r in rows)


def oracle_rows(sql, sf_dir):
    con = duckdb.connect()
    for file in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {Path(file).stem} AS SELECT * FROM read_parquet('{file}')")
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    return sorted(columns), canonical(columns, result.fetchall())


def spark_rows(df):
    return sorted(df.columns), canonical(df.columns, [tuple(r) for r in df.collect()])
