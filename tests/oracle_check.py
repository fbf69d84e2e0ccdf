"""Local copy of the correctness gate: run a catalogue query on Spark and its
oracle SQL on DuckDB over the same parquet tables, then compare row count,
column names and order-insensitive values.

CLI: python tests/oracle_check.py [sf_dir] [key ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def _norm_val(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return repr(float(v))
    if hasattr(v, "isoformat"):
        iso = v.isoformat()
        return iso[:10] if iso[10:].strip("T0:.") == "" else iso
    return str(v)


def _kind(s: pd.Series) -> str:
    if s.isna().all():
        return "null"
    dt = str(s.dtype)
    if dt.startswith("int") or dt.startswith("Int"):
        return dt.lower()
    if dt.startswith("float"):
        return dt
    if dt == "bool":
        return "bool"
    if dt.startswith("datetime"):
        return "date"
    v = s.dropna().iloc[0]
    if hasattr(v, "isoformat"):
        return "date"
    if isinstance(v, bool):
        return "bool"
    if isinstance(v, int):
        return "int64"
    if isinstance(v, float):
        return "float64"
    return type(v).__name__


def normalise(df: pd.DataFrame) -> list[tuple]:
    cols = sorted(df.columns)
    rows = []
    for rec in df[cols].itertuples(index=False, name=None):
        rows.append(tuple(_norm_val(None if (not isinstance(v, (list, tuple)) and pd.isna(v)) else v)
                          for v in rec))
    return sorted(rows, key=lambda r: tuple("" if x is None else x for x in r))


def compare(spark, key: str, sf_dir: str, con=None, verbose: bool = True) -> dict:
    import __spark_entry__ as E
    q = E.queries()[key]
    sql = E.oracle_sql().get(key)
    t0 = time.time()
    sdf = q(spark, sf_dir).toPandas()
    t1 = time.time()
    res = {"key": key, "spark_rows": len(sdf), "spark_sec": round(t1 - t0, 2)}
    if sql is None:
        res["status"] = "no-oracle"
        return res
    con = con or duck(sf_dir)
    ddf = con.execute(sql).fetchdf()
    res["oracle_rows"] = len(ddf)
    res["oracle_sec"] = round(time.time() - t1, 2)
    if sorted(sdf.columns) != sorted(ddf.columns):
        res["status"] = "schema"
        res["detail"] = (sorted(set(sdf.columns) - set(ddf.columns)), sorted(set(ddf.columns) - set(sdf.columns)))
        return res
    kinds = {}
    for c in sdf.columns:
        ks, kd = _kind(sdf[c]), _kind(ddf[c])
        if ks != kd and "null" not in (ks, kd):
            kinds[c] = (ks, kd)
    if kinds:
        res["types"] = kinds
    a, b = normalise(sdf), normalise(ddf)
    if len(a) != len(b):
        res["status"] = "rows"
    elif a != b:
        res["status"] = "values"
        cols = sorted(sdf.columns)
        bad = set()
        sa, sb = set(a), set(b)
        da, db = [r for r in a if r not in sb][:3], [r for r in b if r not in sa][:3]
        for ra, rb in zip(da, db):
            for i, c in enumerate(cols):
                if ra[i] != rb[i]:
                    bad.add(c)
        res["detail"] = {"cols": sorted(bad), "spark": da[:2], "oracle": db[:2]}
    else:
        res["status"] = "ok"
    if verbose:
        print(res, flush=True)
    return res


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    keys = argv[2:]
    from upshelf.session import get_session
    import __spark_entry__ as E
    spark = get_session()
    con = duck(sf_dir)
    keys = keys or list(E.queries())
    out = [compare(spark, k, sf_dir, con) for k in keys]
    bad = [r for r in out if r.get("status") not in ("ok", "no-oracle") or r.get("types")]
    print("SUMMARY", len(out), "checked,", len(bad), "failing:", [r["key"] for r in bad])
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
