"""Runs a query's SQL in DuckDB and compares it with the Spark result, rows in any order."""

import os

import duckdb


def as_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    norm = lambda v: round(v, 6) if isinstance(v, float) else v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


def same(spark, sf_dir, query, sql):
    got = query(spark, sf_dir)
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf_dir}/{f}'")
    want = con.sql(sql)
    columns = want.columns
    assert sorted(got.columns) == sorted(columns)
    left, right = as_rows(got.columns, [tuple(r) for r in got.collect()]), as_rows(columns, want.fetchall())
    assert left == right, (len(left), len(right), [x for x in zip(left, right) if x[0] != x[1]][:3])
