"""Run registered Spark questions against their DuckDB oracle.

Usage: python tests/compare.py [sf_dir] [key ...]
Prints one line per key: rows, columns and an order-insensitive value hash.
"""

from __future__ import annotations

import hashlib
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, ".")

# STRICT=1: compare doubles bit for bit instead of to 9 significant digits
STRICT = os.environ.get("STRICT", "0") == "1"

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        if math.isnan(v):
            return None
        if v == int(v) and abs(v) < 2**53:
            return int(v)
        return v if STRICT else float(f"{v:.9g}")
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return tuple(norm(x) for x in v)
    try:
        import decimal
        if isinstance(v, decimal.Decimal):
            return norm(float(v))
    except Exception:
        pass
    return v


def digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted(repr(tuple(norm(r[i]) for i in order)) for r in rows)
    return hashlib.sha1("\n".join(lines).encode()).hexdigest()[:12], lines


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    keys = sys.argv[2:]
    from marketlens.session import get_session
    import __spark_entry__ as E
    spark = get_session()
    qs, orc = E.queries(), E.oracle_sql()
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    bad = 0
    for k in (keys or sorted(qs)):
        t0 = time.time()
        try:
            df = qs[k](spark, sf_dir)
            srows = [tuple(r) for r in df.collect()]
            scols = df.columns
        except Exception as e:  # noqa: BLE001
            print(f"{k:8s} SPARK-ERROR {type(e).__name__}: {str(e)[:300]}")
            bad += 1
            continue
        ts = time.time() - t0
        if k not in orc:
            print(f"{k:8s} rows={len(srows)} (no oracle) {ts:.1f}s")
            continue
        try:
            cur = con.execute(orc[k])
            ocols = [d[0] for d in cur.description]
            orows = cur.fetchall()
        except Exception as e:  # noqa: BLE001
            print(f"{k:8s} ORACLE-ERROR {type(e).__name__}: {str(e)[:300]}")
            bad += 1
            continue
        hs, ls = digest(scols, srows)
        ho, lo = digest(ocols, orows)
        ok = sorted(scols) == sorted(ocols) and len(srows) == len(orows) and hs == ho
        status = "OK" if ok else "MISMATCH"
        print(f"{k:8s} {status} rows={len(srows)}/{len(orows)} {ts:.1f}s")
        if not ok:
            bad += 1
            if sorted(scols) != sorted(ocols):
                print("   cols spark:", sorted(scols), "\n   cols duck: ", sorted(ocols))
            else:
                diff_s = [x for x in ls if x not in set(lo)][:3]
                diff_o = [x for x in lo if x not in set(ls)][:3]
                print("   spark-only:", diff_s, "\n   oracle-only:", diff_o)
    print("FAILED" if bad else "ALL OK", bad)


if __name__ == "__main__":
    main()
