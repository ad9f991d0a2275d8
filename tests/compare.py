"""Runs every registered query and its SQL statement on the same tables and compares the rows."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def cell(value):
    if value is None or value is pd.NaT or value is pd.NA or (isinstance(value, float) and math.isnan(value)):
        return "null"
    if isinstance(value, bool) or type(value).__name__ == "bool":
        return str(bool(value))
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, float) and value == int(value) if isinstance(value, float) and math.isfinite(value) else False:
        return repr(float(value) + 0.0)
    if isinstance(value, int):
        return repr(float(value)) if abs(value) < 2**53 else repr(value)
    return repr(value) if isinstance(value, float) else str(value)


def rows(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(cell(v) for v in r) for r in frame.itertuples(index=False, name=None))


def difference(mine: pd.DataFrame, theirs: pd.DataFrame) -> str | None:
    if sorted(mine.columns) != sorted(theirs.columns):
        return f"columns {sorted(mine.columns)} vs {sorted(theirs.columns)}"
    if len(mine) != len(theirs):
        return f"rows {len(mine)} vs {len(theirs)}"
    a, b = rows(mine), rows(theirs)
    wrong = [(x, y) for x, y in zip(a, b) if x != y]
    if wrong:
        return f"{len(wrong)} rows differ; columns {sorted(mine.columns)}; first: {wrong[0]}"
    kinds = {n: (mine[n].dtype.kind, theirs[n].dtype.kind) for n in mine.columns if mine[n].dtype.kind != theirs[n].dtype.kind}
    return f"kinds only: {kinds}" if kinds else None


def main() -> None:
    sys.path.insert(0, ".")
    import __spark_entry__ as entry
    from mailsift.session import local_session

    folder = sys.argv[1]
    wanted = set(sys.argv[2:])
    spark = local_session(os.environ.get("MAILSIFT_CORES", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(folder)
    statements = entry.oracle_sql()
    bad = 0
    for name, build in entry.queries().items():
        if wanted and name not in wanted:
            continue
        try:
            begin = time.time()
            mine = build(spark, folder).toPandas()
            spent = time.time() - begin
            if name not in statements:
                print(f"rows {name}: {len(mine)} rows {spent:.2f}s", flush=True)
                continue
            begin = time.time()
            theirs = con.execute(statements[name]).df()
            sql_spent = time.time() - begin
            problem = difference(mine, theirs)
        except Exception as error:  # noqa: BLE001
            problem, spent, sql_spent, mine = f"{type(error).__name__}: {str(error)[:700]}", 0.0, 0.0, []
        bad += problem is not None
        print(f"{'BAD ' if problem else 'ok  '} {name}: {len(mine)} rows, spark {spent:.2f}s sql {sql_spent:.2f}s {problem or ''}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
