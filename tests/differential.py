"""Run every registered query on Spark and its SQL on DuckDB and compare
row count, schema and an order-insensitive value hash.

    python tests/differential.py [sf_dir] [name ...]
"""

from __future__ import annotations

import hashlib
import sys
import time

import duckdb

sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])

import __spark_entry__ as E  # noqa: E402
from vitalrates.session import local_session  # noqa: E402

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]


def _norm(v):
    if isinstance(v, float):
        return repr(round(v, 6) + 0.0)
    return repr(v)


def digest(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted("|".join(_norm(r[i]) for i in order) for r in rows)
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()[:16]


def run(sf_dir: str, names=None) -> dict:
    spark = local_session()
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    qs, sql = E.queries(), E.oracle_sql()
    out = {}
    for name in names or qs:
        t0 = time.time()
        df = qs[name](spark, sf_dir)
        srows = [tuple(r) for r in df.collect()]
        scols = df.columns
        t1 = time.time()
        rel = con.execute(sql[name])
        ocols = [d[0] for d in rel.description]
        orows = rel.fetchall()
        ok = (len(srows) == len(orows) and sorted(scols) == sorted(ocols)
              and digest(srows, scols) == digest(orows, ocols))
        out[name] = ok
        print(f"{'OK ' if ok else 'BAD'} {name:36s} rows {len(srows):6d}/{len(orows):6d} spark {t1 - t0:6.2f}s",
              flush=True)
    return out


if __name__ == "__main__":
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    res = run(sf, sys.argv[2:] or None)
    print(f"{sum(res.values())}/{len(res)} match")
