"""Run registered Spark queries and their DuckDB oracles side by side.

Usage: python tests/oracle_harness.py [sf_dir] [key-substring ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6)
    if hasattr(v, "item") and not isinstance(v, (str, bytes)):
        try:
            return _norm(v.item())
        except Exception:
            pass
    if v.__class__.__name__ == "Decimal":
        return round(float(v), 6)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return [cols[i] for i in order], sorted(out, key=lambda t: tuple((x is None, str(x)) for x in t))


def compare(spark, con, key, build, sql, sf_dir):
    t0 = time.time()
    df = build(spark, sf_dir)
    srows = [tuple(r) for r in df.collect()]
    scols = df.columns
    t1 = time.time()
    rel = con.sql(sql)
    dcols = rel.columns
    drows = rel.fetchall()
    sc, sr = canon(scols, srows)
    dc, dr = canon(dcols, drows)
    ok = sc == dc and len(sr) == len(dr) and sr == dr
    msg = ""
    if not ok:
        if sc != dc:
            msg = f"cols spark={sc} duck={dc}"
        elif len(sr) != len(dr):
            msg = f"rows spark={len(sr)} duck={len(dr)}"
        else:
            bad = [(a, b) for a, b in zip(sr, dr) if a != b][:3]
            msg = f"values differ e.g. {bad}"
    types = [(f.name, f.dataType.simpleString()) for f in df.schema.fields]
    dtypes = list(zip(dcols, [str(t) for t in rel.types]))
    return ok, len(srows), t1 - t0, msg, types, dtypes


def main():
    from basketry.session import get_spark
    from __spark_entry__ import oracle_sql, queries
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    pats = sys.argv[2:]
    spark = get_spark("local[8]", shuffle_partitions=8, **{"spark.ui.enabled": "false"})
    con = duck(sf_dir)
    qs, sqls = queries(), oracle_sql()
    n_ok = n_bad = 0
    for key in sorted(qs):
        if pats and not any(p in key for p in pats):
            continue
        if key not in sqls:
            t0 = time.time()
            n = qs[key](spark, sf_dir).count()
            print(f"ROWS {key}: {n} rows {time.time()-t0:.1f}s")
            continue
        try:
            ok, n, dt, msg, types, dtypes = compare(spark, con, key, qs[key], sqls[key], sf_dir)
        except Exception as e:  # report and continue
            ok, n, dt, msg, types, dtypes = False, -1, 0, f"ERROR {type(e).__name__}: {str(e)[:400]}", [], []
        n_ok += ok
        n_bad += not ok
        print(f"{'OK  ' if ok else 'FAIL'} {key}: {n} rows {dt:.1f}s {msg}")
        if os.environ.get("SHOW_TYPES"):
            print("   spark:", types)
            print("   duck: ", dtypes)
    print(f"summary ok={n_ok} fail={n_bad}")


if __name__ == "__main__":
    main()
