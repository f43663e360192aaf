"""Run queries() against oracle_sql() the way the driver does: DuckDB over the
same parquet files, rows compared order-insensitively with columns sorted by
name.  Usage: python tests/oracle_check.py [sf_dir] [name ...]"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

from askwell.sources.tables import TABLES  # noqa: E402

import os  # noqa: E402

STRICT = os.environ.get("ORACLE_STRICT") == "1"


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else (v if STRICT else round(v, 6))
    if isinstance(v, decimal.Decimal):
        return str(v) if STRICT else decimal.Decimal(v).normalize()
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    return v


def canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = sorted(
        (tuple(_norm(r[i]) for i in order) for r in rows),
        key=lambda r: tuple((x is None, str(x)) for x in r),
    )
    return [cols[i] for i in order], out


def compare(spark, con, name, fn, sql, sf_dir):
    t0 = time.time()
    df = fn(spark, sf_dir)
    srows = [tuple(r) for r in df.collect()]
    scols = df.columns
    t1 = time.time()
    if sql is None:
        return dict(name=name, ok=None, rows=len(srows), spark_s=round(t1 - t0, 2))
    cur = con.execute(sql)
    dcols = [d[0] for d in cur.description]
    drows = cur.fetchall()
    sc, sr = canon(scols, srows)
    dc, dr = canon(dcols, drows)
    ok = sc == dc and sr == dr
    info = dict(name=name, ok=ok, rows=len(srows), oracle_rows=len(drows), spark_s=round(t1 - t0, 2))
    if not ok:
        info["cols"] = (sc, dc)
        diff_s = [r for r in sr if r not in set(dr)][:3]
        diff_d = [r for r in dr if r not in set(sr)][:3]
        info["diff"] = (diff_s, diff_d)
    return info


def main():
    import __spark_entry__ as E
    from askwell.session import build_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    spark = build_session("local[8]")
    con = duck(sf_dir)
    qs, os_ = E.queries(), E.oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if names and name not in names:
            continue
        try:
            info = compare(spark, con, name, fn, os_.get(name), sf_dir)
        except Exception as exc:  # report and continue
            info = dict(name=name, ok=False, error=repr(exc)[:600])
        if info.get("ok") is False:
            bad += 1
        print(info, flush=True)
    print(f"mismatches: {bad} of {len([n for n in qs if not names or n in names])}")


if __name__ == "__main__":
    main()
