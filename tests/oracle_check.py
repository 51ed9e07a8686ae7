"""Run registered queries against their DuckDB oracle SQL and report matches.

Usage: python tests/oracle_check.py [--sf DIR] [name-substring ...]
"""
from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v, digits=6):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, float | np.floating):
        if math.isnan(v):
            return None
        r = round(float(v), digits)
        return 0.0 if r == 0 else r
    if isinstance(v, decimal.Decimal):
        return _norm(float(v), digits)
    if isinstance(v, bool | np.bool_):
        return bool(v)
    if isinstance(v, int | np.integer):
        return int(v)
    if isinstance(v, pd.Timestamp | dt.datetime):
        return pd.Timestamp(v).tz_localize(None).isoformat() if pd.Timestamp(v).tzinfo else pd.Timestamp(v).isoformat()
    if isinstance(v, dt.date):
        return pd.Timestamp(v).isoformat()
    if isinstance(v, list | tuple | np.ndarray):
        return tuple(_norm(x, digits) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x, digits)) for k, x in v.items()))
    if v is pd.NaT:
        return None
    return v


def frame_rows(df: pd.DataFrame, digits=6):
    cols = sorted(df.columns)
    rows = []
    for rec in df[cols].itertuples(index=False, name=None):
        rows.append(tuple(_norm(x, digits) for x in rec))
    rows.sort(key=repr)
    return cols, rows


def compare(spark_pdf: pd.DataFrame, duck_pdf: pd.DataFrame):
    sc, sr = frame_rows(spark_pdf)
    dc, dr = frame_rows(duck_pdf)
    if sc != dc:
        return False, f"columns differ: spark={sc} duck={dc}"
    if len(sr) != len(dr):
        return False, f"rows differ: spark={len(sr)} duck={len(dr)}"
    if sr == dr:
        return True, f"exact ({len(sr)} rows)"
    _, sr4 = frame_rows(spark_pdf, 3)
    _, dr4 = frame_rows(duck_pdf, 3)
    if sr4 == dr4:
        return True, f"approx-3dp ({len(sr)} rows)"
    bad = [(a, b) for a, b in zip(sr, dr) if a != b][:2]
    return False, f"values differ, e.g. {bad}"


def main(argv):
    sf = "/root/testdata/sf0.01"
    if "--sf" in argv:
        i = argv.index("--sf")
        sf = argv[i + 1]
        argv = argv[:i] + argv[i + 2:]
    from freightline.catalog import load_all
    from freightline.session import get_session
    spark = get_session(master="local[8]", shuffle_partitions=8)
    reg = load_all()
    con = duck(sf)
    names = [n for n in reg if not argv or any(a in n for a in argv)]
    ok = bad = skip = 0
    for n in names:
        fn, sql = reg[n]
        t = time.time()
        try:
            sp = fn(spark, sf).toPandas()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {n}: spark error {type(e).__name__}: {str(e)[:300]}")
            bad += 1
            continue
        ts = time.time() - t
        if not sql:
            print(f"ROWS {n}: {len(sp)} rows ({ts:.1f}s, no oracle)")
            skip += 1
            continue
        try:
            dd = con.sql(sql).df()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {n}: duckdb error {str(e)[:300]}")
            bad += 1
            continue
        good, msg = compare(sp, dd)
        print(f"{'OK  ' if good else 'FAIL'} {n}: {msg} ({ts:.1f}s)")
        ok += good
        bad += not good
    print(f"summary: {ok} ok, {bad} fail, {skip} rows-only")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
