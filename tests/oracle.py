"""Comparison of a Spark result with DuckDB's."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return v.isoformat() if hasattr(v, "isoformat") else v


def rows_of(columns, names, rows):
    at = [names.index(c) for c in columns]
    return sorted((tuple(_norm(r[i]) for i in at) for r in rows), key=str)


def assert_same(df, con, sql):
    columns = sorted(df.columns)
    got = rows_of(columns, df.columns, df.collect())
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = rows_of(columns, names, result.fetchall())
    assert len(got) == len(want)
    assert got == want
