"""Run registered queries against their DuckDB SQL: python -m tests.compare [sf] [key ...]"""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, float) and v == 0:
        return 0.0
    return v


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(_plain(r[i]) for i in order) for r in rows]
    return [names[i] for i in order], sorted(out, key=lambda r: tuple((x is None, str(type(x)), x) for x in r) if all(
        not isinstance(x, (list, dict)) for x in r) else str(r))


def compare(spark_df, con, sql: str) -> str | None:
    """None when both sides hold the same rows, otherwise what differs."""
    left_names, left = _rows(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    cur = con.execute(sql)
    right_names, right = _rows([c[0] for c in cur.description], cur.fetchall())
    if left_names != right_names:
        return f"columns {left_names} vs {right_names}"
    if len(left) != len(right):
        return f"rows {len(left)} vs {len(right)}; {left[:2]} vs {right[:2]}"
    bad = [(a, b) for a, b in zip(left, right) if a != b]
    if bad:
        return f"{len(bad)} of {len(left)} rows differ, first {bad[0]}"
    kinds = [{type(x).__name__ for r in side for x in r if x is not None} for side in (left, right)]
    if kinds[0] != kinds[1]:
        return f"types {kinds}"
    return None


def main(argv):
    sys.path.insert(0, ".")
    import __spark_entry__ as entry
    from flowstream.session import build_session

    sf = argv[0] if argv else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    spark = build_session("local[8]")
    spark.sparkContext.setLogLevel("ERROR")
    con, queries, oracle = connect(sf_dir), entry.queries(), entry.oracle_sql()
    for key in argv[1:] or queries:
        t = time.time()
        try:
            df = queries[key](spark, sf_dir)
            note = (compare(df, con, oracle[key]) or "ok") if key in oracle else f"rows {df.count()}"
        except Exception as e:  # report and go on
            note = f"ERROR {type(e).__name__} {str(e)[:600]}"
        print(f"{key:28s} {time.time() - t:6.1f}s  {note}", flush=True)


if __name__ == "__main__":
    main(sys.argv[1:])
