"""Runs a query and its SQL on the same tables and compares the rows."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"


def oracle_rows(sql, columns):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(columns)
    return [tuple(r[names.index(c)] for c in columns) for r in cur.fetchall()]


def key(row):
    return tuple((v is None, str(v)) for v in row)


def assert_same(spark, query, sql):
    df = query(spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(r) for r in df.select(*[f"`{c}`" for c in columns]).collect()), key=key)
    assert got == sorted(oracle_rows(sql, columns), key=key)
