"""Run every query in Spark and its SQL in DuckDB over the same tables and compare the rows.

    python tests/compare.py [sf_dir] [name ...]
"""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


SQL_TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP"}


def connect(sf_dir):
    import duckdb

    db = duckdb.connect()
    for name in os.listdir(sf_dir):
        db.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{name}'")
    return db


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=repr)


def differences(spark, db, sf_dir, name, query, sql):
    started = time.time()
    df = query(spark, sf_dir)
    rows = df.collect()
    took = time.time() - started
    types = {row[0]: row[1] for row in db.execute(f"DESCRIBE {sql}").fetchall()}
    result = db.execute(sql)
    want_columns = [d[0] for d in result.description]
    want = result.fetchall()
    if sorted(df.columns) != sorted(want_columns):
        return f"columns {sorted(df.columns)} != {sorted(want_columns)}", len(rows), took
    if types != {c: SQL_TYPES[t] for c, t in df.dtypes}:
        return f"types {df.dtypes} != {types}", len(rows), took
    got, want = plain(rows, df.columns), plain(want, want_columns)
    if got == want:
        return None, len(rows), took
    missing, extra = list(set(want) - set(got))[:2], list(set(got) - set(want))[:2]
    return f"rows {len(got)} != {len(want)}; only in SQL {missing}; only in Spark {extra}", len(rows), took


if __name__ == "__main__":
    from __spark_entry__ import oracle_sql, queries
    from siftlog.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(queries())
    session = local_session(8)
    session.sparkContext.setLogLevel("ERROR")
    database = connect(sf_dir)
    bad = 0
    for name in names:
        problem, count, took = differences(session, database, sf_dir, name, queries()[name], oracle_sql()[name])
        bad += problem is not None
        print(f"{'ok ' if problem is None else 'BAD'} {name:32s} {count:8d} rows {took:7.2f}s {(problem or '')[:600]}", flush=True)
    sys.exit(bad)
