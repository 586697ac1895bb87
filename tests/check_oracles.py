"""Run registered queries and their oracles side by side and compare the rows.

    python tests/check_oracles.py [folder with tables] [query ...]
"""

from __future__ import annotations

import math
import pathlib
import sys
import time

import duckdb

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

from __spark_entry__ import oracle_sql, queries  # noqa: E402
from codeloom.session import local_session  # noqa: E402


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for file in sorted(pathlib.Path(folder).glob("*.parquet")):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 9))
    return repr(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def kind(name: str) -> str:
    simple = {"INTEGER": "int", "BIGINT": "bigint", "VARCHAR": "string", "DOUBLE": "double",
              "BOOLEAN": "boolean", "HUGEINT": "hugeint", "FLOAT": "float"}
    return simple.get(name, name)


def compare(spark, con, folder: str, name: str) -> str:
    started = time.time()
    df = queries()[name](spark, folder)
    got = [tuple(r) for r in df.collect()]
    spark_s = time.time() - started
    sql = oracle_sql().get(name)
    if sql is None:
        return f"rows {len(got)} ({spark_s:.1f}s)"
    started = time.time()
    found = con.execute(sql)
    columns = [d[0] for d in found.description]
    want = found.fetchall()
    sql_s = time.time() - started
    types = dict(con.execute(f"SELECT column_name, column_type FROM (DESCRIBE {sql})").fetchall())
    times = f"({spark_s:.1f}s / {sql_s:.1f}s)"
    if sorted(df.columns) != sorted(columns):
        return f"FAIL columns {sorted(df.columns)} {sorted(columns)}"
    off = {c: (t, kind(types[c])) for c, t in df.dtypes if t != kind(types[c])}
    a, b = rows_of(df.columns, got), rows_of(columns, want)
    if a != b:
        extra = [x for x in a if x not in set(b)][:2]
        lost = [x for x in b if x not in set(a)][:2]
        return f"FAIL rows {len(a)} {len(b)} {times} {sorted(columns)}\n   spark {extra}\n   sql   {lost}"
    return f"ok {len(a)} {times}" + (f" TYPES {off}" if off else "")


if __name__ == "__main__":
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    names = sys.argv[2:] or list(queries())
    session = local_session("check", 8)
    session.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    bad = 0
    for name in names:
        try:
            verdict = compare(session, con, folder, name)
        except Exception as exc:
            verdict = f"FAIL {type(exc).__name__}: {str(exc)[:600]}"
        bad += verdict.startswith("FAIL")
        print(f"{name}: {verdict}", flush=True)
    print("failed:", bad, "of", len(names), "without oracle:",
          [n for n in names if n not in oracle_sql()])
