"""Compare registered queries with their SQL twin.

``python -m tests.oracle_check [--sf DIR] [name ...]`` (names may be prefixes).
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb
import pandas as pd


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(glob.glob(f"{folder}/*.parquet")):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"create view {name} as select * from read_parquet('{path}')")
    return con


def canonical(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]

    def cell(v):
        if v is None or (isinstance(v, float) and math.isnan(v)) or v is pd.NA or v is pd.NaT:
            return None
        if isinstance(v, float):
            return v + 0.0
        if hasattr(v, "item"):
            return cell(v.item())
        return v

    rows = [tuple(cell(v) for v in r) for r in df.itertuples(index=False)]
    return sorted(rows, key=repr)


def same(a: list[tuple], b: list[tuple]) -> tuple[bool, str]:
    """Equal to the last digit: queries round their numbers themselves, alike in both languages."""
    if len(a) != len(b):
        return False, f"rows {len(a)} vs {len(b)}; spark head {a[:2]} sql head {b[:2]}"
    different = [(x, y) for x, y in zip(a, b) if x != y]
    return (False, f"{len(different)} rows, first {different[0][0]} vs {different[0][1]}") if different else (True, "")


def main(argv: list[str]) -> int:
    from tests.session import local_session

    folder = "/root/testdata/sf0.01"
    if argv and argv[0] == "--sf":
        folder, argv = argv[1], argv[2:]
    import __spark_entry__ as entry

    queries, oracle = entry.queries(), entry.oracle_sql()
    names = [n for n in queries if not argv or any(n == a or (a.endswith("*") and n.startswith(a[:-1])) for a in argv)]
    spark, con = local_session(int(os.environ.get("CPUS", "8"))), connect(folder)
    bad = 0
    for name in names:
        start = time.time()
        try:
            got = queries[name](spark, folder).toPandas()
            took = time.time() - start
            if name not in oracle:
                print(f"rows {name} {len(got)} {took:.1f}s", flush=True)
                continue
            start = time.time()
            want = con.execute(oracle[name]).df()
            sql_took = time.time() - start
            if sorted(got.columns) != sorted(want.columns):
                ok, why = False, f"columns {list(got.columns)} vs {list(want.columns)}"
            else:
                ok, why = same(canonical(got), canonical(want))
            print(f"{'ok  ' if ok else 'FAIL'} {name} rows={len(got)} {took:.1f}s sql={sql_took:.1f}s {why[:600]}", flush=True)
            bad += not ok
        except Exception as exc:  # noqa: BLE001 - report and go on with the next query
            bad += 1
            print(f"ERR  {name} {type(exc).__name__} {str(exc)[:900]}", flush=True)
    print(f"{len(names)} checked, {bad} bad")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
