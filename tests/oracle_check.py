"""Run registered queries on Spark and their SQL on DuckDB and compare the values.

    python -m tests.oracle_check [--sf DIR] [--split ROWS] [name ...]

``--split`` forces the path for hot entities: every entity above ROWS rows is cut into pieces.
"""

from __future__ import annotations

import datetime
import math
import os
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf: str):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)):
        return round(float(v), 6) + 0.0
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    if isinstance(v, datetime.date):
        return v.isoformat()
    return str(v)


KIND = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE"}


def compare(spark, con, fn, sql: str, sf: str) -> str | None:
    df = fn(spark, sf)
    cols = sorted(df.columns)
    got = df.select(*[f"`{c}`" for c in cols]).collect()
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    kinds = {d[0]: str(d[1]) for d in res.description}
    want = res.fetchall()
    if sorted(names) != cols:
        return f"columns {cols} vs {sorted(names)}"
    notes = [f"{c}:{t}/{kinds[c]}" for c, t in df.dtypes if KIND.get(t) != kinds[c]]
    at = [names.index(c) for c in cols]
    a = sorted((tuple(cell(v) for v in r) for r in got), key=repr)
    b = sorted((tuple(cell(r[i]) for i in at) for r in want), key=repr)
    if len(a) != len(b):
        return f"rows {len(a)} vs {len(b)}; e.g. {a[:2]} / {b[:2]}"
    for x, y in zip(a, b):
        if x != y:
            return f"values {cols}\n   spark {x}\n   duck  {y}"
    if notes:
        return "types " + ", ".join(notes)
    return None if a else "empty"


def main(argv: list[str]) -> int:
    import __spark_entry__ as entry
    from formline.session import local_session

    sf = "/root/testdata/sf0.01"
    if "--sf" in argv:
        i = argv.index("--sf")
        sf = argv[i + 1]
        del argv[i : i + 2]
    rows = None
    if "--split" in argv:
        i = argv.index("--split")
        rows = argv[i + 1]
        del argv[i : i + 2]
    spark = local_session("oracle-check")
    if rows:
        spark.conf.set("spark.formline.smallInputBytes", "0")
        spark.conf.set("spark.formline.splitRows", rows)
    con = connect(sf)
    queries, oracle = entry.queries(), entry.oracle_sql()
    names = argv or list(queries)
    bad = 0
    for n in names:
        t = time.time()
        try:
            if n in oracle:
                err = compare(spark, con, queries[n], oracle[n], sf)
            else:
                rows = queries[n](spark, sf).collect()
                err = None if rows else "no rows"
        except Exception as e:  # noqa: BLE001
            err = f"{type(e).__name__}: {str(e)[:1500]}"
        bad += err is not None
        print(f"{'ok  ' if err is None else 'FAIL'} {n} {time.time() - t:.1f}s {'' if n in oracle else '(rows)'} {err or ''}", flush=True)
    print(f"{len(names) - bad} of {len(names)} agree")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
