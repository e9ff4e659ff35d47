"""Compare registered queries with their SQL, as sorted values per column name.

    python tests/check_oracle.py [sf_dir] [query ...]
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as entry  # noqa: E402
from pagetrove.session import local_session  # noqa: E402


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for file in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


def sorted_rows(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=repr)


def compare(spark, con, name: str, sf_dir: str) -> tuple[bool, str]:
    started = time.time()
    df = entry.queries()[name](spark, sf_dir)
    ours = sorted_rows(df.columns, df.collect())
    spark_s, started = time.time() - started, time.time()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return True, f"rows only: {len(ours)} ({spark_s:.1f}s)"
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    theirs = sorted_rows(names, rel.fetchall())
    sql_s = time.time() - started
    if sorted(df.columns) != sorted(names):
        return False, f"columns {sorted(df.columns)} vs {sorted(names)}"
    if ours != theirs:
        gone, extra = [r for r in theirs if r not in set(ours)][:2], [r for r in ours if r not in set(theirs)][:2]
        return False, f"{len(ours)} vs {len(theirs)} rows\n   missing {str(gone)[:600]}\n   extra   {str(extra)[:600]}"
    return True, f"{len(ours)} rows (spark {spark_s:.1f}s, sql {sql_s:.1f}s)"


if __name__ == "__main__":
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark, con = local_session(8), connect(sf_dir)
    bad = 0
    for name in sys.argv[2:] or entry.queries():
        try:
            ok, note = compare(spark, con, name, sf_dir)
        except Exception as error:  # keep checking the others
            ok, note = False, f"{type(error).__name__}: {str(error)[:700]}"
        bad += not ok
        print("ok  " if ok else "FAIL", name, note, flush=True)
    sys.exit(bad > 0)
