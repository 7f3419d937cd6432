"""Local stand-in for the driver's correctness gate: run a registered Spark query and
its DuckDB oracle on the same parquet tables and compare row count, column names
and an order-insensitive multiset of rounded values.

    python tests/oracle.py [name ...]        # default: every query with an oracle
"""

from __future__ import annotations

import math
import os
import sys
import time
from decimal import Decimal

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _canon(v, dp=6):
    if v is None:
        return None
    if isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, (float, Decimal)):
        f = round(float(v), dp)
        return 0.0 if f == 0 else f
    if hasattr(v, "item"):
        return _canon(v.item(), dp)
    return v


def rows_of(cols, records):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_canon(r[i]) for i in order) for r in records]
    return sorted(out, key=lambda t: tuple((x is None, str(type(x)), x if x is not None else 0) for x in t))


def compare(spark, name, fn, sql, sf_dir, con):
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    s_rows = [tuple(r) for r in sdf.collect()]
    s_cols = sdf.columns
    t1 = time.time()
    res = con.execute(sql)
    d_cols = [d[0] for d in res.description]
    d_rows = res.fetchall()
    ok_cols = sorted(s_cols) == sorted(d_cols)
    ok_n = len(s_rows) == len(d_rows)
    ok_v = ok_cols and ok_n and rows_of(s_cols, s_rows) == rows_of(d_cols, d_rows)
    return {"name": name, "rows": len(s_rows), "oracle_rows": len(d_rows), "cols": ok_cols, "values": ok_v,
            "spark_s": round(t1 - t0, 2), "s_cols": s_cols, "d_cols": d_cols,
            "diff": None if ok_v else _diff(s_cols, s_rows, d_cols, d_rows)}


def _diff(s_cols, s_rows, d_cols, d_rows):
    a, b = rows_of(s_cols, s_rows), rows_of(d_cols, d_rows)
    sa, sb = set(a), set(b)
    return {"spark_only": list(sa - sb)[:3], "oracle_only": list(sb - sa)[:3]}


def main(argv):
    from __spark_entry__ import oracle_sql, queries
    from clademl.session import get_spark

    sf_dir = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")
    spark = get_spark()
    q, o = queries(), oracle_sql()
    names = argv or [n for n in q if n in o]
    con = duck(sf_dir)
    bad = 0
    for n in names:
        try:
            r = compare(spark, n, q[n], o[n], sf_dir, con)
        except Exception as e:  # report and continue
            print(f"ERROR {n}: {type(e).__name__}: {str(e)[:400]}")
            bad += 1
            continue
        flag = "OK " if r["values"] else "BAD"
        bad += not r["values"]
        print(f"{flag} {n}: rows={r['rows']}/{r['oracle_rows']} cols={r['cols']} t={r['spark_s']}s")
        if not r["values"]:
            print("    ", r["s_cols"], r["d_cols"])
            print("    ", r["diff"])
    print(f"{len(names) - bad}/{len(names)} match")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
