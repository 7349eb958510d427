"""Compare registered queries with their SQL twins. ``python tests/oracle.py [sf_dir] [name prefix ...]``"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, bool):
        return str(v)
    return repr(v)


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(_norm(r[i]) for i in order) for r in rows), sorted(cols)


def compare(spark, con, sf_dir, name, fn, sql):
    t0 = time.time()
    df = fn(spark, sf_dir)
    got, gc = rows_of(df.columns, [tuple(r) for r in df.collect()])
    dt = time.time() - t0
    if sql is None:
        return "rows-only", len(got), dt, None
    rel = con.execute(sql)
    cols = [c[0] for c in rel.description]
    types = {c[0]: str(c[1]) for c in rel.description}
    want, wc = rows_of(cols, rel.fetchall())
    if gc != wc:
        return "COLUMNS", len(got), dt, (gc, wc)
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    same = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    bad = {c: (kinds[c], types[c]) for c in kinds if same.get(kinds[c], "") != types[c]}
    if got != want:
        a, b = set(got), set(want)
        return "DIFF", len(got), dt, (len(got), len(want), sorted(a - b)[:3], sorted(b - a)[:3], bad)
    return ("ok" if not bad else "ok-types"), len(got), dt, bad or None


def main():
    from pyspark.sql import SparkSession

    from shotweave.queries import load_all

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    want = sys.argv[2:]
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.driver.memory", "12g").config("spark.ui.enabled", "false")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    counts: dict[str, int] = {}
    for name, (fn, sql) in load_all().items():
        if want and not any(name.startswith(w) for w in want):
            continue
        try:
            status, n, dt, info = compare(spark, con, sf_dir, name, fn, sql)
        except Exception as e:  # noqa: BLE001
            status, n, dt, info = "ERROR", 0, 0.0, str(e)[:700]
        counts[status] = counts.get(status, 0) + 1
        print(f"{status:9s} {name:40s} rows={n} {dt:.1f}s {info or ''}", flush=True)
    print(counts)
    spark.stop()


if __name__ == "__main__":
    main()
