"""Run registered queries on Spark and their oracle SQL on DuckDB; compare.

usage: python tools/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import sys
import time
from datetime import date, datetime
from decimal import Decimal

sys.path.insert(0, __import__("os").path.dirname(__import__("os").path.dirname(__file__)))

import duckdb  # noqa: E402

from lakeloom.plans.registry import all_oracles, all_queries  # noqa: E402
from lakeloom.session import get_spark  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6)
    if isinstance(v, Decimal):
        return round(float(v), 6)
    if isinstance(v, (bytes, bytearray, memoryview)):
        return bytes(v).hex()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    if isinstance(v, datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, date):
        return v.isoformat()
    if hasattr(v, "asDict"):
        return norm(v.asDict())
    return v


def main():
    args = sys.argv[1:]
    sf = args[0] if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in args if not a.startswith("/")]
    spark = get_spark(master="local[8]", shuffle_partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    qs, oracles = all_queries(), all_oracles()
    bad = 0
    for name in names or sorted(qs):
        t0 = time.time()
        try:
            df = qs[name](spark, sf)
            cols = df.columns
            rows = [tuple(norm(r[c]) for c in sorted(cols)) for r in df.collect()]
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: spark error {type(e).__name__}: {str(e)[:400]}")
            bad += 1
            continue
        ts = time.time() - t0
        if name not in oracles:
            print(f"ROWS {name}: {len(rows)} rows (no oracle) {ts:.2f}s")
            continue
        try:
            cur = con.execute(oracles[name])
            ocols = [d[0] for d in cur.description]
            orows = [tuple(norm(dict(zip(ocols, r))[c]) for c in sorted(ocols)) for r in cur.fetchall()]
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: duckdb error {str(e)[:400]}")
            bad += 1
            continue
        if sorted(cols) != sorted(ocols):
            print(f"FAIL {name}: columns {sorted(cols)} vs {sorted(ocols)}")
            bad += 1
            continue
        key = lambda r: tuple((x is None, str(type(x)), str(x)) for x in r)
        a, b = sorted(rows, key=key), sorted(orows, key=key)
        if a != b:
            diff = [(x, y) for x, y in zip(a, b) if x != y][:2]
            print(f"FAIL {name}: {len(a)} vs {len(b)} rows; first diff {str(diff)[:600]}")
            bad += 1
        else:
            print(f"OK   {name}: {len(a)} rows {ts:.2f}s")
    print(f"{bad} failures")
    spark.stop()


if __name__ == "__main__":
    main()
