"""Side-by-side check of every registered query against its DuckDB oracle.

Mirrors the driver's gate: row count, column names, order-insensitive values.
Usage: python -m tests.oracle [sf_dir] [key ...]
"""
from __future__ import annotations

import datetime as _dt
import decimal
import math
import sys
import time

import duckdb

from pricesieve.sources.tables import BASE_TABLES


def _norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (float, decimal.Decimal)):
        f = float(v)
        if math.isnan(f):
            return "nan"
        return round(f, 6) + 0.0
    if isinstance(v, int):
        return v
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((str(k), _norm(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return tuple(sorted((k, _norm(x)) for k, x in v.asDict().items()))
    if isinstance(v, (_dt.datetime, _dt.date)):
        return v.isoformat()
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=repr)


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in BASE_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def compare(spark, con, sf_dir, key, fn, sql):
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    scols = list(sdf.columns)
    srows = [tuple(r) for r in sdf.collect()]
    t1 = time.time()
    if sql is None:
        return {"key": key, "ok": None, "rows": len(srows), "spark_s": round(t1 - t0, 2)}
    res = con.execute(sql)
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    out = {"key": key, "rows": len(srows), "oracle_rows": len(drows), "spark_s": round(t1 - t0, 2)}
    if sorted(scols) != sorted(dcols):
        out.update(ok=False, why=f"columns {sorted(scols)} vs {sorted(dcols)}")
        return out
    a, b = _rows(scols, srows), _rows(dcols, drows)
    if a != b:
        sa, sb = set(a), set(b)
        out.update(ok=False, why="values", only_spark=list(sa - sb)[:3], only_oracle=list(sb - sa)[:3])
        return out
    out["ok"] = True
    return out


def main(argv):
    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    keys = argv[1:]
    sys.path.insert(0, ".")
    import __spark_entry__ as entry
    from pricesieve.session import local_session

    spark = local_session()
    con = duck(sf_dir)
    qs, oracle = entry.queries(), entry.oracle_sql()
    bad = 0
    for k in keys or list(qs):
        try:
            r = compare(spark, con, sf_dir, k, qs[k], oracle.get(k))
        except Exception as e:  # report and go on
            r = {"key": k, "ok": False, "why": f"error {type(e).__name__}: {str(e)[:400]}"}
        bad += r.get("ok") is False
        print(r, flush=True)
    print(f"mismatches: {bad}")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
