"""Compare a registered query with its SQL on one folder of the provided tables."""

import os

import duckdb

FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


def connection():
    con = duckdb.connect()
    for file in os.listdir(FOLDER):
        path = os.path.join(FOLDER, file)
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def cells(row, order):
    return tuple(f"{float(row[k]):.9g}" if isinstance(row[k], float) else str(row[k]) for k in order)


def assert_same(spark, query, sql):
    df = query(spark, FOLDER)
    got = sorted(cells(r, sorted(range(len(df.columns)), key=lambda k: df.columns[k])) for r in df.collect())
    cursor = connection().execute(sql)
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    assert got == sorted(cells(r, sorted(range(len(names)), key=lambda k: names[k])) for r in cursor.fetchall())
