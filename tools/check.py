"""Compare every named query with its SQL statement in DuckDB: python tools/check.py [sf_dir] [name-prefix ...]"""

from __future__ import annotations

import math
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), ".."))

import duckdb  # noqa: E402

from splicelake.plans import ORACLES, QUERIES  # noqa: E402
from splicelake.session import build_session  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if v is None:
        return ("0",)
    if isinstance(v, bool):
        return ("b", v)
    if isinstance(v, float):
        if math.isnan(v):
            return ("nan",)
        return ("n", round(v, 9) + 0.0)
    if hasattr(v, "as_tuple"):
        return ("n", float(v))
    if isinstance(v, int):
        return ("n", float(v))
    return ("s", str(v))


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(norm(r[i]) for i in order) for r in rows)


def compare(spark, con, name, sf):
    t = time.time()
    df = QUERIES[name](spark, sf)
    got = df.collect()
    secs = time.time() - t
    if name not in ORACLES:
        return f"ROWS {len(got)}", secs
    t = time.time()
    cur = con.execute(ORACLES[name])
    want_cols = [d[0] for d in cur.description]
    want = cur.fetchall()
    dsec = time.time() - t
    if sorted(df.columns) != sorted(want_cols):
        return f"COLUMNS {sorted(df.columns)} != {sorted(want_cols)}", secs
    g, w = rows_of(df.columns, got), rows_of(want_cols, want)
    if g != w:
        diff = [(a, b) for a, b in zip(g, w) if a != b][:3]
        return f"DIFF rows {len(g)} vs {len(w)} first {diff}", secs
    return f"ok {len(g)} duck={dsec:.2f}s" + ("  EMPTY" if not g else ""), secs


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    prefixes = sys.argv[2:]
    spark = build_session("check", "local[8]", 8, progress=False)
    spark.sparkContext.setLogLevel("ERROR")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    bad = []
    for name in QUERIES:
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        try:
            msg, secs = compare(spark, con, name, sf)
        except Exception as e:
            msg, secs = "ERROR " + "".join(traceback.format_exception_only(e))[:1500], 0.0
        if not msg.startswith(("ok", "ROWS")) or "EMPTY" in msg:
            bad.append(name)
        print(f"{secs:6.2f}s {name:40s} {msg}", flush=True)
    print("BAD", len(bad), bad)
    spark.stop()


if __name__ == "__main__":
    main()
