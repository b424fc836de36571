"""Run registered queries beside their oracles: python tests/compare.py [--sf DIR] [key ...]."""

from __future__ import annotations

import decimal
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, decimal.Decimal):
        return repr(float(v))
    return repr(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in rows), sorted(columns)


def compare(spark, con, key, query, sql, sf_dir):
    """(matches, message)"""
    t0 = time.time()
    df = query(spark, sf_dir)
    got, got_cols = rows_of(df.columns, [tuple(r) for r in df.collect()])
    t1 = time.time()
    if sql is None:
        return True, f"rows-only {len(got)} rows {t1 - t0:.1f}s"
    cur = con.execute(sql)
    want, want_cols = rows_of([d[0] for d in cur.description], cur.fetchall())
    t2 = time.time()
    timing = f"{len(got)} rows spark {t1 - t0:.1f}s duck {t2 - t1:.1f}s"
    if got_cols != want_cols:
        return False, f"columns {got_cols} != {want_cols}"
    if got == want:
        return True, timing
    lines = [f"{len(got)} vs {len(want)} rows"]
    only_got = [r for r in got if r not in set(want)]
    only_want = [r for r in want if r not in set(got)]
    lines += [f"  spark {r}"[:1500] for r in only_got[:2]] + [f"  duck  {r}"[:1500] for r in only_want[:2]]
    lines.append(f"  ({len(only_got)} / {len(only_want)} differ) columns {got_cols}")
    return False, timing + "\n" + "\n".join(lines)


def main():
    import __spark_entry__ as entry
    from hazardloom.session import local_session

    args = sys.argv[1:]
    sf_dir = "/root/testdata/sf0.01"
    if args and args[0] == "--sf":
        sf_dir, args = args[1], args[2:]
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    keys = args or list(queries)
    bad = []
    for key in keys:
        try:
            ok, message = compare(spark, con, key, queries[key], oracles.get(key), sf_dir)
        except Exception as e:  # report and go on with the other keys
            ok, message = False, f"{type(e).__name__}: {str(e)[:350]}"
        print(("ok   " if ok else "FAIL ") + key, message, flush=True)
        if not ok:
            bad.append(key)
    print(f"{len(keys) - len(bad)} of {len(keys)} match; failing: {bad}")
    spark.stop()


if __name__ == "__main__":
    main()
