"""Compare registered queries with DuckDB, value by value.

Run as ``python -m structlake.plans.verify <data folder> [name prefix …]``.
"""

from __future__ import annotations

import math
import sys
import time

TABLES = ("region", "nation", "customer", "supplier", "part", "orders",
          "lineitem", "events", "documents", "embeddings", "pages",
          "benchmark", "labels", "conversations")


def duck_connection(folder: str):
    import duckdb

    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(
            f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return connection


def _plain(value):
    if isinstance(value, float):
        return "NaN" if math.isnan(value) else value + 0.0
    return value


_KINDS = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER",
          "double": "DOUBLE", "boolean": "BOOLEAN", "float": "FLOAT"}


def compare(frame, connection, sql: str) -> str | None:
    """None when both engines agree, else the first difference."""
    columns = sorted(frame.columns)
    kinds = {n: _KINDS.get(t, t) for n, t in frame.dtypes}
    relation = connection.sql(sql)
    other = dict(zip(relation.columns, (str(t) for t in relation.types)))
    if columns != sorted(other):
        return f"columns {columns} != {sorted(other)}"
    wrong = {c: (kinds[c], other[c]) for c in columns if kinds[c] != other[c]}
    if wrong:
        return f"types {wrong}"

    def ordered(rows):
        return sorted(rows, key=lambda r: tuple((v is None, str(v)) for v in r))

    table = frame.toArrow()
    ours = ordered(zip(*([_plain(v) for v in table.column(c).to_pylist()]
                         for c in columns))) if table.num_rows else []
    index = [list(relation.columns).index(c) for c in columns]
    theirs = ordered(tuple(_plain(r[i]) for i in index) for r in relation.fetchall())
    if len(ours) != len(theirs):
        return f"rows {len(ours)} != {len(theirs)}"
    for left, right in zip(ours, theirs):
        if left != right:
            return f"{columns}: {left} != {right}"
    if not ours:
        return "empty result"
    return None


def main(folder: str, prefixes: list[str]) -> int:
    from ..session import local_session
    from .catalog import load

    load()
    from .registry import ORACLES, QUERIES

    spark = local_session(8)
    connection = duck_connection(folder)
    bad = 0
    for name, build in QUERIES.items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        start = time.time()
        try:
            frame = build(spark, folder)
            if name in ORACLES:
                problem = compare(frame, connection, ORACLES[name])
            else:
                problem = None if frame.collect() else "empty result"
        except Exception as error:  # report and go on
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        mark = "ok  " if problem is None else "FAIL"
        kind = "sql" if name in ORACLES else "rows"
        print(f"{mark} {name} {kind} {time.time() - start:.1f}s", flush=True)
        if problem:
            bad += 1
            print(f"     {problem}", flush=True)
    print(f"{bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1], sys.argv[2:]) else 0)
