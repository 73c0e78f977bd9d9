"""Comparison of a query with its SQL in DuckDB."""

import glob
import math
import os


def connect(folder):
    import duckdb

    c = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(f)[:-8]
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{f if os.path.isfile(f) else f + '/*.parquet'}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    return float(v) if isinstance(v, (int, bool)) else str(v)


def rows(found, columns, have):
    at = [have.index(c) for c in columns]
    return sorted(tuple(plain(r[i]) for i in at) for r in found)


def same(connection, df, sql):
    columns = sorted(df.columns)
    found = connection.execute(sql)
    have = [x[0] for x in found.description]
    assert sorted(have) == columns
    assert rows(df.collect(), columns, df.columns) == rows(found.fetchall(), columns, have)
