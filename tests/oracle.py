"""Compare registered queries with their SQL on DuckDB."""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(int(v)) if v.is_integer() and abs(v) < 1e15 else repr(v)
    if isinstance(v, bool) or v is None:
        return repr(v)
    if hasattr(v, "to_integral_value"):
        return _plain(float(v))
    return repr(v)


def rows_of(columns: list[str], rows: list) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_plain(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir: str, query, sql: str | None) -> tuple[bool, str]:
    started = time.time()
    df = query(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    spent = time.time() - started
    if sql is None:
        return len(got) > 0, f"{len(got)} rows, no oracle, {spent:.1f}s"
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    started = time.time()
    want = rows_of(names, cursor.fetchall())
    note = f"{len(got)} rows, {spent:.1f}s, oracle {time.time() - started:.1f}s"
    if sorted(names) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} != {sorted(names)}"
    if got != want:
        left, right = [r for r in got if r not in set(want)][:2], [r for r in want if r not in set(got)][:2]
        return False, f"{note}; {len(want)} wanted; only spark {str(left)[:400]}; only sql {str(right)[:400]}"
    return len(got) > 0, note


def main(names: list[str]) -> int:
    import __spark_entry__ as entry
    from talkmill.session import local_session

    sf_dir = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.01")
    spark, con = local_session(), connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in names or queries:
        try:
            ok, note = compare(spark, con, sf_dir, queries[name], oracles.get(name))
        except Exception as error:  # noqa: BLE001
            ok, note = False, f"{type(error).__name__}: {str(error)[:600]}"
        bad += not ok
        print("ok  " if ok else "FAIL", name, note, flush=True)
    print(f"{bad} failed")
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
