"""Run registered queries on Spark and their oracle SQL on DuckDB; compare.

Usage: python tests/oracle_compare.py [sf_dir] [name ...]
"""
from __future__ import annotations

import math
import os
import sys
import time

import duckdb
import pandas as pd

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
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        if float(v).is_integer():
            return int(v)       # nullable integer columns arrive as float from Spark
        return repr(float(v))
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, pd.Timestamp):
        return v.isoformat()
    if isinstance(v, float) or (hasattr(v, "dtype") and "float" in str(v.dtype)):
        return _norm(float(v))
    return str(v) if not isinstance(v, (int, bool)) else int(v)


def frame_rows(pdf: pd.DataFrame):
    cols = sorted(pdf.columns)
    rows = [tuple(_norm(r[c]) for c in cols) for r in pdf.to_dict("records")]
    return cols, sorted(rows, key=lambda r: tuple("" if x is None else str(x) for x in r))


def compare(spark, con, name, fn, sql, sf_dir, verbose=True):
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    spdf = sdf.toPandas()
    t1 = time.time()
    dpdf = con.execute(sql).df()
    t2 = time.time()
    sc, sr = frame_rows(spdf)
    dc, dr = frame_rows(dpdf)
    ok = sc == dc and sr == dr
    msg = f"{name}: spark={len(sr)} ({t1-t0:.1f}s) duck={len(dr)} ({t2-t1:.1f}s) {'OK' if ok else 'MISMATCH'}"
    if not ok and verbose:
        if sc != dc:
            msg += f"\n  cols spark-only={sorted(set(sc)-set(dc))} duck-only={sorted(set(dc)-set(sc))}"
        else:
            ss, ds = set(sr), set(dr)
            only_s = [r for r in sr if r not in ds][:3]
            only_d = [r for r in dr if r not in ss][:3]
            msg += f"\n  cols={sc}\n  spark-only={only_s}\n  duck-only={only_d}"
    print(msg, flush=True)
    return ok


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    import __spark_entry__ as E
    if os.environ.get("NETLENS_PLAIN_SESSION"):
        # a session with Spark's defaults only (200 shuffle partitions, local time zone)
        from pyspark.sql import SparkSession
        spark = SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false") \
            .config("spark.ui.showConsoleProgress", "false").getOrCreate()
    else:
        from netlens.session import get_session
        spark = get_session("local[8]", shuffle_partitions=8)
    con = duck(sf_dir)
    qs, sqls = E.queries(), E.oracle_sql()
    bad = 0
    for n, fn in qs.items():
        if names and n not in names:
            continue
        if n not in sqls:
            t0 = time.time()
            c = fn(spark, sf_dir).count()
            print(f"{n}: rows-only {c} ({time.time()-t0:.1f}s)", flush=True)
            continue
        try:
            bad += not compare(spark, con, n, fn, sqls[n], sf_dir)
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"{n}: ERROR {type(e).__name__}: {str(e)[:600]}", flush=True)
    print(f"mismatches: {bad}")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
