"""Compare catalog queries with their oracle SQL.

    python tests/oracle_check.py [folder] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402
from sentrymill.session import local_session  # noqa: E402

TABLES = ["events", "customer", "documents", "pages", "conversations", "embeddings", "benchmark", "labels"]


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _kind(values: list) -> str:
    kinds = {type(v).__name__ for v in values if v is not None}
    return "+".join(sorted(kinds))


def _key(row: tuple) -> tuple:
    return tuple((v is None, str(v) if not isinstance(v, float) else f"{v:.6f}") for v in row)


def _same(a, b) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)
    return type(a) is type(b) and a == b


def difference(spark, con, name: str, folder: str) -> str | None:
    """None when the query and its SQL agree, else what differs."""
    df = entry.queries()[name](spark, folder)
    mine_columns = sorted(df.columns)
    mine = [tuple(r) for r in df.select(*[f"`{c}`" for c in mine_columns]).collect()]
    result = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    theirs = [tuple(row[i] for i in order) for row in result.fetchall()]
    if mine_columns != sorted(columns):
        return f"columns {mine_columns} != {sorted(columns)}"
    if len(mine) != len(theirs):
        return f"{len(mine)} rows != {len(theirs)} rows"
    mine.sort(key=_key)
    theirs.sort(key=_key)
    for a, b in zip(mine, theirs):
        if not all(_same(x, y) for x, y in zip(a, b)):
            return f"{dict(zip(mine_columns, a))} != {dict(zip(mine_columns, b))}"
    return None


def main() -> None:
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(entry.queries())
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    bad = 0
    for name in names:
        start = time.time()
        try:
            problem = difference(spark, con, name, folder)
        except Exception as e:  # report and go on with the next query
            problem = f"{type(e).__name__}: {str(e)[:600]}"
        bad += problem is not None
        print(f"{'FAIL' if problem else 'ok':4} {name} {time.time() - start:.1f}s {problem or ''}", flush=True)
    print(f"{len(names) - bad} of {len(names)} agree")


if __name__ == "__main__":
    main()
