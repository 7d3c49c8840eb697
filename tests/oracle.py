"""Run queries and their SQL side by side: ``python tests/oracle.py [sf] [name ...]``."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages"
    " benchmark labels conversations"
).split()


def duck(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float) and math.isnan(value):
        return "NaN"
    if isinstance(value, float):
        return value + 0.0
    return value


def rows_of(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


TYPES = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "float": "FLOAT"}


def type_differences(df, answer_types: dict[str, str]) -> list[str]:
    """Columns whose SQL type is not the one the query returns."""
    found = []
    for field in df.schema:
        mine = field.dataType.simpleString()
        mine = TYPES.get(mine, mine.upper())
        if mine.replace(" ", "") != answer_types[field.name].replace(" ", ""):
            found.append(f"{field.name}: {mine} / {answer_types[field.name]}")
    return found


def compare(spark, con, sf: str, name: str, run, sql: str | None) -> str:
    df = run(spark, sf)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return f"rows {len(got)}"
    answer = con.execute(sql)
    columns = [c[0] for c in answer.description]
    want = rows_of(columns, answer.fetchall())
    if sorted(columns) != sorted(df.columns):
        return f"DIFF columns {sorted(df.columns)} != {sorted(columns)}"
    if got != want:
        first = next(((g, w) for g, w in zip(got, want) if g != w), None)
        return f"DIFF rows {len(got)} != {len(want)}; first {first}"[:600]
    differ = type_differences(df, {c[0]: str(c[1]) for c in answer.description})
    return f"ok {len(got)}" + (f" types {differ}" if differ else "")


def main() -> None:
    import __spark_entry__ as entry_module
    from poolsift.session import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session(
        "oracle", "local[8]", **{"spark.sql.shuffle.partitions": 8, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf)
    sqls = entry_module.oracle_sql()
    bad = 0
    for name, run in entry_module.queries().items():
        if len(sys.argv) > 2 and name not in sys.argv[2:]:
            continue
        start = time.time()
        try:
            verdict = compare(spark, con, sf, name, run, sqls.get(name))
        except Exception as problem:  # noqa: BLE001
            verdict = f"ERROR {type(problem).__name__}: {str(problem)[:700]}"
        bad += verdict.startswith(("DIFF", "ERROR"))
        print(f"{name:28s} {time.time() - start:6.2f}s  {verdict}", flush=True)
    print(f"{bad} bad")


if __name__ == "__main__":
    main()
