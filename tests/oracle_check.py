"""Compare registered queries with their SQL: names, row counts and values."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _plain(value: object) -> object:
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return value


def differences(con: duckdb.DuckDBPyConnection, frame, sql: str) -> str | None:
    """None when both sides give the same rows, else what differs."""
    names = sorted(frame.columns)
    rows = frame.select(*names).collect()
    result = con.execute(f"SELECT {', '.join(names)} FROM ({sql})")
    expected = result.fetchall()
    ours = sorted((tuple(map(_plain, r)) for r in rows), key=repr)
    theirs = sorted((tuple(map(_plain, r)) for r in expected), key=repr)
    if len(ours) != len(theirs):
        return f"{len(ours)} rows, expected {len(theirs)}"
    for a, b in zip(ours, theirs, strict=True):
        if a != b:
            return f"columns {names}: {a} but expected {b}"
    types = {n: t for n, t in zip(names, (str(d[1]) for d in result.description), strict=True)}
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    spark_types = dict(frame.dtypes)
    odd = {n: (spark_types[n], types[n]) for n in names if kinds.get(spark_types[n], types[n]) != types[n]}
    return f"types differ: {odd}" if odd else None


if __name__ == "__main__":
    from __spark_entry__ import oracle_sql, queries
    from runlens.session import local_session

    folder = sys.argv[1]
    wanted = sys.argv[2:]
    spark = local_session(8)
    con = connect(folder)
    sql = oracle_sql()
    bad = 0
    for name, run in queries().items():
        if wanted and name not in wanted:
            continue
        began = time.time()
        try:
            frame = run(spark, folder)
            found = differences(con, frame, sql[name]) if name in sql else f"no SQL; {frame.count()} rows"
        except Exception as error:  # noqa: BLE001
            found = f"{type(error).__name__}: {str(error)[:600]}"
        bad += found is not None
        print(f"{'ok ' if found is None else 'BAD'} {name} {time.time() - began:.1f}s {found or ''}", flush=True)
    print(f"{bad} differ")
