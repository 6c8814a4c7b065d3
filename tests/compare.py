"""Run registered queries on Spark and DuckDB and compare their rows.

``python tests/compare.py [-s sf] [name ...]`` prints one line per query.
"""

from __future__ import annotations

import datetime
import decimal
import glob
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def plain(value):
    if isinstance(value, decimal.Decimal):
        return ("decimal", str(value))
    if isinstance(value, bool):
        return ("bool", value)
    if isinstance(value, float):
        return ("float", "nan" if value != value else repr(value + 0.0))
    if isinstance(value, int):
        return ("int", value)
    if isinstance(value, datetime.datetime):
        return ("time", value.isoformat())
    if isinstance(value, datetime.date):
        return ("date", value.isoformat())
    if value is None:
        return ("null",)
    return (type(value).__name__, value)


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(plain(r[i]) for i in order) for r in map(tuple, rows))


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


SAME_TYPE = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
    "date": "DATE", "timestamp_ntz": "TIMESTAMP",
}


def type_differences(df, description) -> list[str]:
    theirs = {d[0]: str(d[1]) for d in description}
    return [f"{n}: {t} / {theirs.get(n)}" for n, t in df.dtypes if SAME_TYPE.get(t) != theirs.get(n)]


def compare(spark, con, sf_dir: str, name: str, query, sql: str | None) -> tuple[bool, str]:
    start = time.time()
    df = query(spark, sf_dir)
    rows = df.collect()
    spent = time.time() - start
    if sql is None:
        return bool(rows), f"rows={len(rows)} spark={spent:.2f}s no sql"
    start = time.time()
    result = con.execute(sql)
    description = result.description
    names = [d[0] for d in description]
    expected = result.fetchall()
    ducked = time.time() - start
    left, right = canonical(df.columns, rows), canonical(names, expected)
    note = f"rows={len(rows)}/{len(expected)} spark={spent:.2f}s duck={ducked:.2f}s"
    if left[0] != right[0]:
        return False, f"{note} columns {left[0]} / {right[0]}"
    if left[1] != right[1]:
        a, b = set(left[1]), set(right[1])
        return False, f"{note}\n   only spark: {sorted(a - b)[:3]}\n   only duck:  {sorted(b - a)[:3]}"
    types = type_differences(df, description)
    if types:
        return False, f"{note} types {types}"
    return True, note if rows else note + " EMPTY"


if __name__ == "__main__":
    import __spark_entry__ as entry
    from gleanframe.session import local_session

    args = sys.argv[1:]
    sf = "0.01"
    if args[:1] == ["-s"]:
        sf, args = args[1], args[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark, con = local_session(8), duck(sf_dir)
    queries, sqls = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in args or queries:
        try:
            ok, note = compare(spark, con, sf_dir, name, queries[name], sqls.get(name))
        except Exception as error:
            ok, note = False, f"{type(error).__name__}: {str(error)[:900]}"
        bad += not ok
        print("ok  " if ok else "BAD ", name, note, flush=True)
    print("bad:", bad, "of", len(args or queries))
    print("without sql:", [n for n in queries if n not in sqls])
