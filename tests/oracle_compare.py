"""Compare registered Spark queries with their DuckDB oracle SQL.

Mirrors the driver's check: row count, column names, and an
order-insensitive comparison of values with columns sorted by name.
Usable from pytest and as a script::

    python tests/oracle_compare.py /root/testdata/sf0.01 [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb
import pandas as pd

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 9)
    if hasattr(v, "item"):
        return _norm(v.item())
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def canonical(df: pd.DataFrame) -> tuple[list[str], list[tuple]]:
    cols = sorted(c.lower() for c in df.columns)
    df = df.rename(columns={c: c.lower() for c in df.columns})[cols]
    rows = [tuple(_norm(v) for v in r) for r in df.itertuples(index=False, name=None)]
    rows.sort(key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))
    return cols, rows


def compare(spark, sf_dir: str, names: list[str] | None = None, verbose: bool = True) -> dict[str, str]:
    import __spark_entry__ as E

    qs = E.queries()
    sql = E.oracle_sql()
    con = duck(sf_dir)
    out = {}
    for name in names or list(qs):
        if name not in sql:
            out[name] = "no-oracle"
            continue
        t0 = time.time()
        try:
            sdf = qs[name](spark, sf_dir).toPandas()
        except Exception as e:  # noqa: BLE001
            out[name] = f"spark-error: {type(e).__name__}: {str(e)[:300]}"
            if verbose:
                print(name, out[name], flush=True)
            continue
        t1 = time.time()
        try:
            ddf = con.execute(sql[name]).df()
        except Exception as e:  # noqa: BLE001
            out[name] = f"duckdb-error: {str(e)[:300]}"
            if verbose:
                print(name, out[name], flush=True)
            continue
        sc, sr = canonical(sdf)
        dc, dr = canonical(ddf)
        if sc != dc:
            status = f"columns differ: spark={sc} duckdb={dc}"
        elif len(sr) != len(dr):
            status = f"row count differs: spark={len(sr)} duckdb={len(dr)}"
        elif sr != dr:
            bad = [(a, b) for a, b in zip(sr, dr) if a != b][:3]
            status = f"values differ: {bad}"
        else:
            status = "ok"
        out[name] = status
        if verbose:
            print(f"{name:40s} {status[:400]}  rows={len(sr)} spark={t1 - t0:.1f}s", flush=True)
    return out


if __name__ == "__main__":
    from equitally.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or None
    spark = local_session(8)
    res = compare(spark, sf, names)
    bad = {k: v for k, v in res.items() if v != "ok"}
    print(f"{len(res) - len(bad)}/{len(res)} ok")
    for k, v in bad.items():
        print("  ", k, v[:300])
