"""Run registered queries on Spark and their SQL on DuckDB, and compare whole results."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tidymeter.catalog.base import TABLES  # noqa: E402


TYPES = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean"}


def kind(value) -> str:
    return type(value).__name__


def canon(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(v):
        if isinstance(v, float):
            if math.isnan(v):
                return ("nan",)
            return (v,)
        return (v,)

    return sorted(
        (tuple(cell(r[i])[0] for i in order) for r in rows),
        key=lambda t: tuple((x is not None, str(type(x)), x if x is not None else 0) for x in t),
    )


def connect(sf: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def compare(spark, con, sf, name, run, sql):
    start = time.time()
    df = run(spark, sf)
    columns = df.columns
    rows = [tuple(r) for r in df.collect()]
    took = time.time() - start
    if sql is None:
        return f"rows-only {len(rows)}", took, len(rows) > 0
    cur = con.execute(sql)
    spark_types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    for d in cur.description:
        want = TYPES.get(str(d[1]))
        if d[0] in spark_types and want != spark_types[d[0]]:
            return f"type of {d[0]}: {spark_types[d[0]]} != {d[1]}", took, False
    other_columns = [d[0] for d in cur.description]
    other = cur.fetchall()
    if sorted(columns) != sorted(other_columns):
        return f"columns {sorted(columns)} != {sorted(other_columns)}", took, False
    if len(rows) != len(other):
        return f"rows {len(rows)} != {len(other)}", took, False
    a, b = canon(rows, columns), canon(other, other_columns)
    names = sorted(columns)
    for x, y in zip(a, b):
        if x != y:
            bad = [(n, p, q) for n, p, q in zip(names, x, y) if p != q]
            return f"values differ: {bad[:4]}", took, False
        for n, p, q in zip(names, x, y):
            if kind(p) != kind(q):
                return f"type of {n}: {kind(p)} != {kind(q)}", took, False
    return f"ok {len(rows)}", took, len(rows) > 0


def main():
    import __spark_entry__ as entry
    from tidymeter.session import local_session

    sf = sys.argv[1]
    wanted = sys.argv[2:]
    spark = local_session(8)
    con = connect(sf)
    queries, sqls = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, run in queries.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        try:
            note, took, good = compare(spark, con, sf, name, run, sqls.get(name))
        except Exception as exc:  # report and go on
            note, took, good = f"{type(exc).__name__}: {str(exc)[:700]}", 0.0, False
        bad += not good
        print(f"{'OK  ' if good else 'FAIL'} {name:36s} {took:6.2f}s  {note}", flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main()
