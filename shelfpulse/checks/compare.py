"""Local oracle check: run each registered Spark query and its DuckDB statement on
the same parquet tables and compare row count, column names and values.

    python -m shelfpulse.checks.compare [--sf /root/testdata/sf0.01] [key ...]

Values are compared order-insensitively after sorting columns by name; doubles
are compared exactly and, separately, after rounding to 9 significant digits so
an exact mismatch from summation order is told apart from a real one.
"""

from __future__ import annotations

import argparse
import datetime as dt
import decimal
import math
import sys
import time

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def _norm(v, approx: bool):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        if approx:
            return float(f"{v:.9g}")
        return v
    if isinstance(v, decimal.Decimal):
        return _norm(float(v), approx)
    if isinstance(v, dt.datetime):
        return v.isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x, approx) for x in v)
    if hasattr(v, "tolist"):
        return _norm(v.tolist(), approx)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x, approx)) for k, x in v.items()))
    return v


def _rows(cols, rows, approx):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i], approx) for i in order) for r in rows]
    return sorted(out, key=lambda t: tuple((x is None, str(x)) for x in t))


def duck_con(sf: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def main(argv=None):
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("keys", nargs="*")
    a = ap.parse_args(argv)

    from shelfpulse.checks import registry
    from shelfpulse.session import get_session
    registry.load_all()
    spark = get_session("local[8]", 8)
    con = duck_con(a.sf)
    keys = a.keys or list(registry.QUERIES)
    bad = 0
    for k in keys:
        t0 = time.time()
        try:
            sdf = registry.QUERIES[k](spark, a.sf)
            srows = [tuple(r) for r in sdf.collect()]
            scols = sdf.columns
        except Exception as e:  # noqa: BLE001
            print(f"{k:32s} SPARK-ERROR {type(e).__name__}: {str(e)[:300]}")
            bad += 1
            continue
        ts = time.time() - t0
        sql = registry.ORACLE.get(k)
        if sql is None:
            print(f"{k:32s} rows={len(srows):7d} (no oracle) {ts:.1f}s")
            continue
        try:
            res = con.execute(sql)
            dcols = [d[0] for d in res.description]
            drows = res.fetchall()
        except Exception as e:  # noqa: BLE001
            print(f"{k:32s} DUCK-ERROR {str(e)[:300]}")
            bad += 1
            continue
        status = []
        if sorted(scols) != sorted(dcols):
            status.append(f"COLS spark={sorted(scols)} duck={sorted(dcols)}")
        if len(srows) != len(drows):
            status.append(f"ROWS spark={len(srows)} duck={len(drows)}")
        if not status:
            ex = _rows(scols, srows, False) == _rows(dcols, drows, False)
            ap_ = _rows(scols, srows, True) == _rows(dcols, drows, True)
            if not ex:
                status.append("VALUES-EXACT-DIFF" + ("" if ap_ else " VALUES-APPROX-DIFF"))
                if not ap_:
                    s1 = _rows(scols, srows, True)
                    d1 = _rows(dcols, drows, True)
                    diff = [(x, y) for x, y in zip(s1, d1) if x != y][:2]
                    status.append(f"first diffs: {diff}")
        if status:
            bad += 1
        print(f"{k:32s} rows={len(srows):7d} {'OK' if not status else ' '.join(status)} {ts:.1f}s")
        sys.stdout.flush()
    print(f"mismatched: {bad} of {len(keys)}")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
