"""Run catalogue queries on Spark and their DuckDB oracle; compare.

    python tools/check_oracle.py [sf_dir] [name ...]

Compares row count, column names and an order-insensitive multiset of rows
(columns sorted by name), printing the first differing rows on mismatch.
"""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from carelog.plans.catalog import ORACLE, QUERIES  # noqa: E402
from carelog.session import get_spark  # noqa: E402
from carelog.sources.tables import DRIVER_TABLES  # noqa: E402


def norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6)
    if hasattr(v, "is_finite"):  # Decimal
        return round(float(v), 6)
    return v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i].lower())
    return Counter(tuple(norm(r[i]) for i in order) for r in rows), [cols[i].lower() for i in order]


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark = get_spark("local[8]", 8, extra={"spark.driver.memory": "4g"})
    con = duckdb.connect()
    for t in DRIVER_TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    bad = 0
    for n in names:
        t0 = time.time()
        try:
            df = QUERIES[n](spark, sf)
            srows = [tuple(r) for r in df.collect()]
            scols = df.columns
        except Exception as e:  # noqa: BLE001
            print(f"{n:28s} SPARK ERROR {type(e).__name__}: {str(e)[:300]}")
            bad += 1
            continue
        ts = time.time() - t0
        if n not in ORACLE:
            print(f"{n:28s} rows-only {len(srows)} ({ts:.1f}s)")
            continue
        try:
            res = con.execute(ORACLE[n])
            dcols = [d[0] for d in res.description]
            drows = res.fetchall()
        except Exception as e:  # noqa: BLE001
            print(f"{n:28s} DUCKDB ERROR {str(e)[:400]}")
            bad += 1
            continue
        sc, sn = rows_of(scols, srows)
        dc, dn = rows_of(dcols, drows)
        ok = sn == dn and sc == dc
        print(f"{n:28s} {'OK ' if ok else 'BAD'} spark={len(srows)} duck={len(drows)} ({ts:.1f}s)")
        if not ok:
            bad += 1
            if sn != dn:
                print("   cols spark-only", sorted(set(sn) - set(dn)), "duck-only", sorted(set(dn) - set(sn)))
            else:
                print("   spark-only", list((sc - dc).items())[:3])
                print("   duck-only ", list((dc - sc).items())[:3])
    print("mismatches:", bad)


if __name__ == "__main__":
    main()
