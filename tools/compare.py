"""Runs registered queries against their SQL in DuckDB and compares all values.

    python tools/compare.py [sf_dir] [name ...]
"""

from __future__ import annotations

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def duck(sf: str):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(repr(r[i]) for i in order) for r in rows)


def compare(spark, con, sf: str, name: str, query) -> str:
    """``ok`` or what differs."""
    start = time.time()
    df = query.run(spark, sf)
    got = [tuple(r) for r in df.collect()]
    if query.sql is None:
        return "ok" if got else "no rows"
    middle = time.time()
    rel = con.sql(query.sql)
    want = rel.fetchall()
    print(f"[{middle - start:.1f}s against {time.time() - middle:.1f}s]", end=" ")
    if sorted(df.columns) != sorted(rel.columns):
        return f"columns {sorted(df.columns)} / {sorted(rel.columns)}"
    a, b = rows_of(df.columns, got), rows_of(rel.columns, want)
    if len(a) != len(b):
        return f"rows {len(a)} / {len(b)}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return f"{len(bad)} of {len(a)} rows differ: {str(bad[0])[:600]}"
    return "ok" if a else "no rows"


def main() -> None:
    from bitexture.plans.catalog import QUERIES
    from bitexture.session import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark = build_session("compare", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con, failed = duck(sf), 0
    for name in names:
        start = time.time()
        try:
            result = compare(spark, con, sf, name, QUERIES[name])
        except Exception as err:  # report and go on
            result = f"error {type(err).__name__}: {str(err)[:700]}"
        failed += result != "ok"
        kind = "" if QUERIES[name].sql else " (rows only)"
        print(f"{name:32s} {time.time() - start:6.1f}s {result}{kind}", flush=True)
    print(f"{len(names) - failed} of {len(names)} ok")


if __name__ == "__main__":
    main()
