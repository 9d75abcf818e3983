"""Compare registered queries with their SQL in DuckDB, as a script or from tests."""

from __future__ import annotations

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def canonical(frame) -> list[tuple]:
    columns = sorted(frame.columns)
    rows = []
    for row in frame[columns].astype(object).where(frame[columns].notna(), None).itertuples(index=False):
        rows.append(tuple(repr(_plain(v)) for v in row))
    return sorted(rows)


def _plain(v):
    if v is None:
        return None
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if hasattr(v, "item"):
        v = v.item()
    return v


def compare(spark, con, run, sql, sf) -> tuple[bool, str]:
    t = time.time()
    got = run(spark, sf).toPandas()
    t1 = time.time()
    if sql is None:
        return True, f"{len(got)} rows, no SQL, {t1 - t:.1f}s"
    want = con.execute(sql).fetchdf()
    t2 = time.time()
    note = f"{len(got)} rows, spark {t1 - t:.1f}s, duckdb {t2 - t1:.1f}s"
    if sorted(got.columns) != sorted(want.columns):
        return False, f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    a, b = canonical(got), canonical(want)
    if a == b:
        return True, note
    differ = [(x, y) for x, y in zip(a, b) if x != y]
    return False, f"{note}; {len(a)} vs {len(b)} rows, {len(differ)} differ, first {differ[:2]}"


if __name__ == "__main__":
    from barloom.catalogue import ENTRIES
    from barloom.session import local_session

    sf = f"/root/testdata/{sys.argv[1]}"
    names = sys.argv[2:] or list(ENTRIES)
    session, db = local_session("8"), connect(sf)
    failed = []
    for name in names:
        try:
            ok, note = compare(session, db, *ENTRIES[name], sf)
        except Exception as error:  # report and go on
            ok, note = False, f"{type(error).__name__}: {str(error)[:600]}"
        print("ok  " if ok else "FAIL", name, note, flush=True)
        failed += [] if ok else [name]
    print(f"{len(names) - len(failed)} of {len(names)} match; failed: {failed}")
