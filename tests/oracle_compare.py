"""Local stand-in for the driver's check: run each registered query and its DuckDB
oracle on the same tables, compare row count, column names and sorted values."""

from __future__ import annotations

import math
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, __import__("os").path.dirname(__import__("os").path.dirname(__import__("os").path.abspath(__file__))))

from tillscope.sources.driver_tables import TABLES


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return round(v, 6)
    if hasattr(v, "to_pydatetime"):
        return v.to_pydatetime().replace(tzinfo=None)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if hasattr(v, "tolist"):
        return _norm(v.tolist())
    return v


def rows(df: pd.DataFrame) -> list:
    cols = sorted(df.columns)
    out = [tuple(_norm(r[c]) for c in cols) for r in df.to_dict("records")]
    return sorted(out, key=lambda t: tuple((x is None, str(type(x)), x if x is not None else 0) for x in t))


def compare(spark, sf_dir: str, names=None, verbose=True) -> dict:
    from __spark_entry__ import oracle_sql, queries
    qs, orc = queries(), oracle_sql()
    con = duck(sf_dir)
    res = {}
    for name in names or qs:
        t0 = time.time()
        try:
            sdf = qs[name](spark, sf_dir)
            s = sdf.toPandas()
            st = time.time() - t0
            if name not in orc:
                res[name] = ("rows-only", len(s), round(st, 1))
            else:
                d = con.execute(orc[name]).df()
                ok_cols = sorted(s.columns) == sorted(d.columns)
                ok = ok_cols and len(s) == len(d) and rows(s) == rows(d)
                res[name] = ("OK" if ok else "MISMATCH", len(s), len(d), round(st, 1),
                             None if ok_cols else (sorted(s.columns), sorted(d.columns)))
        except Exception as e:  # noqa: BLE001
            res[name] = ("ERROR", str(e)[:400])
        if verbose:
            print(name, res[name], flush=True)
    return res


if __name__ == "__main__":
    sys.path.insert(0, "/root/repo")
    from tillscope.session import get_spark
    spark = get_spark(8)
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2].split(",") if len(sys.argv) > 2 else None
    r = compare(spark, sf, names)
    bad = [k for k, v in r.items() if v[0] not in ("OK", "rows-only")]
    print("BAD:", bad)
