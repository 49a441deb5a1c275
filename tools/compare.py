"""Run registered queries against their SQL and report differences.

    python tools/compare.py [--sf sf0.01] [--only prefix[,prefix]] [--no-sql]
"""

from __future__ import annotations

import argparse
import math
import os
import sys
import time
import traceback

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{folder}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return 0.0 if value == 0 else value
    if hasattr(value, "asDict"):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(plain(v) for v in value.values())
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def ordered(rows, names):
    cols = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in cols) for r in rows), key=repr)


def compare(spark_rows, spark_names, sql_rows, sql_names) -> str | None:
    if sorted(spark_names) != sorted(sql_names):
        return f"columns {sorted(spark_names)} != {sorted(sql_names)}"
    a, b = ordered(spark_rows, spark_names), ordered(sql_rows, sql_names)
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}"
    bad = [(x, y) for x, y in zip(a, b) if repr(x) != repr(y)]
    if bad:
        return f"{len(bad)}/{len(a)} rows differ, e.g. {sorted(spark_names)}\n     {bad[0][0]}\n     {bad[0][1]}"
    return None


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="sf0.01")
    ap.add_argument("--only", default="")
    ap.add_argument("--no-sql", action="store_true")
    args = ap.parse_args()
    from risklattice.queries import ORACLES, QUERIES, load_all
    from risklattice.session import get_session

    load_all()
    spark = get_session(8)
    folder = f"/root/testdata/{args.sf}"
    con = connect(folder)
    wanted = [p for p in args.only.split(",") if p]
    failed = 0
    for name, fn in QUERIES.items():
        if wanted and not any(name.startswith(p) for p in wanted):
            continue
        try:
            start = time.time()
            df = fn(spark, folder)
            rows = df.collect()
            took = time.time() - start
            if args.no_sql or name not in ORACLES:
                print(f"rows {name:34s} {len(rows):8d} {took:6.2f}s")
                continue
            start = time.time()
            cur = con.execute(ORACLES[name])
            names = [c[0] for c in cur.description]
            expected = cur.fetchall()
            sql_took = time.time() - start
            types = [str(c[1]) for c in cur.description]
            wide = [n for n, t in zip(names, types) if "HUGEINT" in t or "DECIMAL" in t]
            problem = compare(rows, df.columns, expected, names)
            if not problem and not rows:
                problem = "no rows"
            if wide:
                problem = f"{problem or ''} wide SQL types {wide}"
            if problem:
                failed += 1
            print(f"{'FAIL' if problem else 'ok  '} {name:34s} {len(rows):8d} {took:6.2f}s sql {sql_took:5.2f}s {problem or ''}")
        except Exception:  # noqa: BLE001
            failed += 1
            lines = traceback.format_exc().strip().splitlines()
            print(f"FAIL {name}\n   " + "\n   ".join(lines[-1:])[:1500])
            if os.environ.get("TRACE"):
                print("\n".join(lines[-30:]))
        sys.stdout.flush()
    print("failed:", failed)
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
