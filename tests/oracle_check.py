"""Run registered queries on Spark and their oracle SQL on DuckDB; compare.

Usage: python tests/oracle_check.py [SF_DIR] [name ...]
Compares row count, column names and an order-insensitive hash of values.
"""

from __future__ import annotations

import hashlib
import math
import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def _norm(v):
    if v is None:
        return None
    if hasattr(v, "item") and not isinstance(v, (list, tuple, str, bytes)):
        try:
            v = v.item()
        except Exception:
            pass
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6)
    if isinstance(v, (list, tuple)) or (hasattr(v, "tolist") and not isinstance(v, str)):
        seq = v.tolist() if hasattr(v, "tolist") else v
        return tuple(_norm(x) for x in seq)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    return v


def digest(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    keyed = sorted(repr(tuple(_norm(r[i]) for i in order)) for r in rows)
    h = hashlib.sha256()
    for k in keyed:
        h.update(k.encode())
    return [columns[i] for i in order], len(rows), h.hexdigest()


def duck_connect(sf_dir):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def run_one(spark, con, name, fn, sql, sf_dir):
    t0 = time.time()
    df = fn(spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    t1 = time.time()
    s = digest(df.columns, rows)
    if sql is None:
        return dict(name=name, status="rows-only", rows=s[1], spark_s=round(t1 - t0, 2))
    res = con.execute(sql)
    cols = [c[0] for c in res.description]
    drows = res.fetchall()
    t2 = time.time()
    o = digest(cols, drows)
    ok = s == o
    out = dict(name=name, status="match" if ok else "MISMATCH", rows=s[1], oracle_rows=o[1],
               spark_s=round(t1 - t0, 2), duck_s=round(t2 - t1, 2))
    if not ok:
        out["cols"] = (s[0], o[0])
        a = sorted(repr(tuple(_norm(r[df.columns.index(c)]) for c in s[0])) for r in rows)
        b = sorted(repr(tuple(_norm(r[cols.index(c)]) for c in o[0])) for r in drows)
        diff_a = [x for x in a if x not in set(b)][:2]
        diff_b = [x for x in b if x not in set(a)][:2]
        out["spark_only"] = [x[:600] for x in diff_a]
        out["oracle_only"] = [x[:600] for x in diff_b]
    return out


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:]
    import __spark_entry__ as E
    from precis.session import get_spark
    spark = get_spark("local[8]", shuffle_partitions=8)
    con = duck_connect(sf_dir)
    qs, os_ = E.queries(), E.oracle_sql()
    bad = 0
    for name in (names or list(qs)):
        try:
            r = run_one(spark, con, name, qs[name], os_.get(name), sf_dir)
        except Exception as e:  # noqa: BLE001
            r = dict(name=name, status="ERROR", error=str(e)[:1500])
        bad += r["status"] in ("MISMATCH", "ERROR")
        print(r, flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
