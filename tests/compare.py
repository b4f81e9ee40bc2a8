"""Run registered queries next to their SQL twins and report differences.

    python -m tests.compare [--sf 0.01] [name ...]
"""

import argparse
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def oracle(sql, folder):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    return names, cur.fetchall()


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, bool) or v is None:
        return v
    if hasattr(v, "as_tuple"):
        return round(float(v), 6)
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def check(spark, name, run, sql, folder):
    """None when equal, else what differs."""
    df = run(spark, folder)
    got = df.collect()
    if sql is None:
        return "no SQL to compare with", len(got)
    names, want = oracle(sql, folder)
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}", len(got)
    a, b = rows_of(df.columns, got), rows_of(names, want)
    if a == b:
        return None, len(got)
    only_a = [r for r in a if r not in set(b)][:2]
    only_b = [r for r in b if r not in set(a)][:2]
    return f"rows {len(a)} vs {len(b)}; spark {str(only_a)[:700]} sql {str(only_b)[:700]}", len(got)


def main():
    from __spark_entry__ import oracle_sql, queries
    from wirefold import build_session
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="0.01")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    spark = build_session(master="local[8]", shuffle_partitions=8, **{"spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    sqls, bad = oracle_sql(), 0
    for name, run in queries().items():
        if args.names and name not in args.names:
            continue
        start = time.time()
        try:
            diff, n = check(spark, name, run, sqls.get(name), f"/root/testdata/sf{args.sf}")
        except Exception as exc:  # noqa: BLE001 - report and go on
            diff, n = f"{type(exc).__name__}: {str(exc)[:900]}", -1
        bad += diff is not None
        state = "ok " if diff is None else "BAD"
        print(f"{state} {name:28s} {n:7d} rows {time.time() - start:6.1f}s "
              f"{'' if name in sqls else '(rows only)'} {diff or ''}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
