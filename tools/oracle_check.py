"""Run registered queries on Spark and their DuckDB statements side by side.

usage: python tools/oracle_check.py [sf_dir] [name ...]
Compares row count, column names and an order-insensitive multiset of rows
(doubles rounded to 6 places), the way the driver's correctness gate does.
"""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from textrisk.plans.registry import load_all  # noqa: E402
from textrisk.session import get_session  # noqa: E402
from textrisk.sources.readers import TABLES  # noqa: E402


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6) + 0.0
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    return v


def rows_of(cols, records):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return Counter(tuple(norm(r[i]) for i in order) for r in records)


def main():
    args = sys.argv[1:]
    sf = args[0] if args and os.path.isdir(args[0]) else "/root/testdata/sf0.01"
    plain = "--plain" in args
    names = [a for a in args if not os.path.isdir(a) and a != "--plain"]
    reg = load_all()
    if plain:  # a session with Spark's defaults only, as an outside caller may pass
        from pyspark.sql import SparkSession
        spark = SparkSession.builder.master("local[8]").getOrCreate()
    else:
        spark = get_session("local[8]", 8)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    bad = 0
    for name, q in reg.items():
        if names and name not in names:
            continue
        t0 = time.time()
        try:
            sdf = q.build(spark, sf)
            scols = sdf.columns
            srows = [tuple(r) for r in sdf.collect()]
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: spark error {str(e)[:400]}")
            bad += 1
            continue
        ts = time.time() - t0
        if q.sql is None:
            print(f"rows {name}: {len(srows)} rows, {ts:.1f}s (no oracle)")
            continue
        try:
            res = con.execute(q.sql)
            dcols = [d[0] for d in res.description]
            drows = res.fetchall()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: duckdb error {str(e)[:600]}")
            bad += 1
            continue
        problems = []
        if sorted(scols) != sorted(dcols):
            problems.append(f"columns spark={sorted(scols)} duck={sorted(dcols)}")
        if len(srows) != len(drows):
            problems.append(f"rows spark={len(srows)} duck={len(drows)}")
        if not problems:
            a, b = rows_of(scols, srows), rows_of(dcols, drows)
            if a != b:
                only_s = list((a - b).elements())[:3]
                only_d = list((b - a).elements())[:3]
                problems.append(f"values differ; spark-only {only_s} duck-only {only_d}")
        if problems:
            bad += 1
            print(f"FAIL {name} ({len(srows)} rows, {ts:.1f}s): " + "; ".join(problems))
        else:
            print(f"ok   {name}: {len(srows)} rows, {ts:.1f}s")
    print(f"{bad} failing")
    spark.stop()
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
