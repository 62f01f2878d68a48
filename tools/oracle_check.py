"""Run registered queries on Spark and their SQL twins on DuckDB; compare.

usage: python tools/oracle_check.py [sf_dir] [name ...]

Comparison: row count, column names (sorted), and the multiset of rows with
floats rounded to 6 decimals (order-insensitive).
"""

from __future__ import annotations

import math
import os
import sys
import time
import uuid

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from tessera.plans.catalog import all_oracles, all_queries  # noqa: E402
from tessera.session import get_session, scratch_path  # noqa: E402
from tessera.sources.tables import TABLES  # noqa: E402


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6) + 0.0
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda t: tuple((x is None, str(x)) for x in t))


def main():
    args = sys.argv[1:]
    sf_dir = "/root/testdata/sf0.01"
    if args and args[0].startswith("/"):
        sf_dir, args = args[0], args[1:]
    qs, orc = all_queries(), all_oracles()
    names = args or list(qs)
    spark = get_session(shuffle_partitions=8)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    bad = 0
    for n in names:
        t0 = time.time()
        try:
            sdf = qs[n](spark, sf_dir)
            # written and read again, as a user of the result would
            path = scratch_path(spark, f"oracle-{uuid.uuid4().hex}")
            sdf.write.parquet(path)
            sdf = spark.read.parquet(path)
            scols = sdf.columns
            srows = [tuple(r) for r in sdf.collect()]
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {n}: spark error {str(e)[:400]}")
            bad += 1
            continue
        ts = time.time() - t0
        if n not in orc:
            print(f"ROWS {n}: {len(srows)} rows (no oracle) {ts:.1f}s")
            continue
        try:
            rel = con.execute(orc[n])
            dcols = [d[0] for d in rel.description]
            drows = rel.fetchall()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {n}: duckdb error {str(e)[:400]}")
            bad += 1
            continue
        if sorted(scols) != sorted(dcols):
            print(f"FAIL {n}: columns spark={sorted(scols)} duck={sorted(dcols)}")
            bad += 1
            continue
        a, b = _rows(scols, srows), _rows(dcols, drows)
        if len(a) != len(b):
            print(f"FAIL {n}: rows spark={len(a)} duck={len(b)}")
            bad += 1
            continue
        if a != b:
            diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
            print(f"FAIL {n}: values differ e.g. {diff}")
            bad += 1
            continue
        print(f"OK   {n}: {len(a)} rows {ts:.1f}s")
    print(f"{len(names) - bad}/{len(names)} ok")
    spark.stop()


if __name__ == "__main__":
    main()
