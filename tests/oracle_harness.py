"""Run registered Spark queries and their DuckDB twins; compare the results.

Usage: python tests/oracle_harness.py [sf_dir] [name ...]
"""

from __future__ import annotations

import hashlib
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from sievekit.sources.tables import TABLES  # noqa: E402


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def _norm(v):
    if v is None:
        return "∅"
    if isinstance(v, float):
        if math.isnan(v):
            return "∅"
        return repr(round(v, 9))
    if isinstance(v, bool):
        return str(v)
    if hasattr(v, "isoformat"):
        return v.isoformat(sep=" ") if hasattr(v, "hour") else v.isoformat()
    return str(v)


def table_digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted("\x1f".join(_norm(r[i]) for i in order) for r in rows)
    return hashlib.sha256("\n".join(lines).encode()).hexdigest(), lines


def compare(spark, sf_dir: str, name: str, con=None, verbose=True) -> dict:
    from sievekit.plans.catalog import ORACLE, QUERIES
    con = con or duck(sf_dir)
    t0 = time.time()
    sdf = QUERIES[name](spark, sf_dir)
    s_rows = [tuple(r) for r in sdf.collect()]
    s_cols = sdf.columns
    t1 = time.time()
    res = {"name": name, "spark_rows": len(s_rows), "spark_sec": round(t1 - t0, 2)}
    if name not in ORACLE:
        res["status"] = "rows-only"
        return res
    cur = con.execute(ORACLE[name])
    d_cols = [c[0] for c in cur.description]
    d_rows = [tuple(r) for r in cur.fetchall()]
    res.update(duck_rows=len(d_rows), duck_sec=round(time.time() - t1, 2))
    if sorted(s_cols) != sorted(d_cols):
        res["status"] = f"columns differ: {sorted(set(s_cols) ^ set(d_cols))}"
        return res
    hs, ls = table_digest(s_cols, s_rows)
    hd, ld = table_digest(d_cols, d_rows)
    if hs == hd:
        res["status"] = "match"
        return res
    res["status"] = "MISMATCH"
    # which columns differ (align by sorted key of first column set)
    bad = []
    for c in sorted(s_cols):
        si, di = s_cols.index(c), d_cols.index(c)
        a = sorted(_norm(r[si]) for r in s_rows)
        b = sorted(_norm(r[di]) for r in d_rows)
        if a != b:
            diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
            bad.append((c, diff))
    res["bad_columns"] = bad[:10]
    return res


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.001"
    names = argv[2:]
    from sievekit.plans.catalog import QUERIES
    from sievekit.session import local_session
    spark = local_session()
    con = duck(sf_dir)
    ok = True
    for name in names or list(QUERIES):
        try:
            r = compare(spark, sf_dir, name, con)
        except Exception as e:  # report and continue
            r = {"name": name, "status": f"ERROR {type(e).__name__}: {str(e)[:400]}"}
        ok &= r["status"] in ("match", "rows-only")
        print(r, flush=True)
    return 0 if ok else 1


if __name__ == "__main__":
    sys.exit(main(sys.argv))
