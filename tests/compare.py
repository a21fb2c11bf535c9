"""Runs every registered query next to its SQL restatement and reports differences."""

from __future__ import annotations

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')")
    return con


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(([row[i] for i in order] for row in rows), key=repr)


def difference(spark, con, folder: str, name: str, query, sql: str) -> str | None:
    frame = query(spark, folder)
    ours = rows_of(frame.columns, [tuple(r) for r in frame.collect()])
    cursor = con.execute(sql)
    theirs = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    if ours[0] != theirs[0]:
        return f"columns {ours[0]} / {theirs[0]}"
    if len(ours[1]) != len(theirs[1]):
        a, b = {repr(r) for r in ours[1]}, {repr(r) for r in theirs[1]}
        return f"rows {len(ours[1])} / {len(theirs[1])}; only ours {sorted(a - b)[:2]}; only theirs {sorted(b - a)[:2]}"
    for left, right in zip(ours[1], theirs[1]):
        if left != right:
            return f"first difference {left} / {right}"
    return None


if __name__ == "__main__":
    import __spark_entry__ as entry
    from driftlens.session import build_session

    folder, wanted = sys.argv[1], sys.argv[2:]
    spark = build_session("compare", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("OFF")
    con = connect(folder)
    for name, query in entry.queries().items():
        if wanted and name not in wanted:
            continue
        sql, start = entry.oracle_sql().get(name), time.time()
        if sql is None:
            print(f"{name:30s} no SQL, {query(spark, folder).count()} rows {time.time() - start:.1f}s", flush=True)
            continue
        try:
            problem = difference(spark, con, folder, name, query, sql)
        except Exception as error:  # report and go on
            problem = f"{type(error).__name__}: {str(error)[:500]}"
        print(f"{name:30s} {'ok' if problem is None else 'DIFF ' + problem} {time.time() - start:.1f}s", flush=True)
