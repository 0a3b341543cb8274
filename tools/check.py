"""Run queries next to their SQL twins: ``python tools/check.py [--sf DIR] [name-prefix ...]``."""

from __future__ import annotations

import argparse
import os
import sys
import time
import traceback

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pulsegrid import catalog  # noqa: E402
from pulsegrid.session import local_session  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def canonical(pdf: pd.DataFrame) -> tuple[dict, list]:
    pdf = pdf[sorted(pdf.columns)]
    kinds = {}
    cols = []
    for c in pdf.columns:
        s = pdf[c]
        k = s.dtype.kind
        kinds[c] = {"i": "int", "u": "int", "f": "float", "M": "time", "b": "bool"}.get(k, "object")
        if k == "f":
            cols.append(s.map(lambda v: None if pd.isna(v) else repr(float(v))))
        elif k == "M":
            cols.append(s.astype("datetime64[us]").astype(str))
        else:
            cols.append(s.map(lambda v: None if v is None or (not hasattr(v, "__len__") and pd.isna(v)) else str(
                list(v) if hasattr(v, "tolist") else v)))
    rows = sorted(zip(*cols), key=repr) if cols else []
    return kinds, rows


def compare(spark, con, name, fn, sql, sf):
    t = time.time()
    got = fn(spark, sf).toPandas()
    took = time.time() - t
    if sql is None:
        return f"rows {len(got)}", took, True
    want = con.execute(sql).df()
    gk, gr = canonical(got)
    wk, wr = canonical(want)
    if gk != wk:
        diff = {c: (gk.get(c), wk.get(c)) for c in set(gk) | set(wk) if gk.get(c) != wk.get(c)}
        return f"SCHEMA {diff}", took, False
    if gr != wr:
        sg, sw = set(gr), set(wr)
        a, b = sorted(sg - sw, key=repr)[:3], sorted(sw - sg, key=repr)[:3]
        return (f"VALUES rows {len(gr)}/{len(wr)}; {len(sg - sw)} differ\n   cols {list(gk)}\n"
                f"   spark {a}\n   sql   {b}"), took, False
    return f"ok {len(got)}", took, True


def connect(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    spark = local_session("check")
    con = connect(args.sf)
    sqls = catalog.oracle_sql()
    bad = []
    for name, fn in catalog.queries().items():
        if args.names and not any(name.startswith(p) for p in args.names):
            continue
        try:
            msg, took, ok = compare(spark, con, name, fn, sqls.get(name), args.sf)
        except Exception as e:  # report and go on with the next query
            msg, took, ok = f"ERROR {type(e).__name__}: {str(e)[:700]}", 0.0, False
            if os.environ.get("TRACE"):
                traceback.print_exc()
        print(f"{'  ' if ok else '! '}{name:40s} {took:6.2f}s {msg}", flush=True)
        if not ok:
            bad.append(name)
    print("FAILED" if bad else "ALL OK", bad)
    sys.exit(bool(bad))


if __name__ == "__main__":
    main()
