"""Compare registered queries with their SQL in DuckDB. `python tests/oracle_check.py <sf_dir> [names...]`."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def connect(sf_dir: str):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def plain(value):
    """A value in a form that is equal in both engines only if the results are."""
    if value is None or str(value) in ("NaT", "<NA>", "nan"):
        return None
    if isinstance(value, float) or type(value).__name__.startswith("float"):
        value = float(value)
        return int(value) if math.isfinite(value) and value == int(value) else value
    if type(value).__name__ in ("bool", "bool_"):
        return bool(value)
    if type(value).__name__.startswith(("int", "uint")):
        return int(value)
    return str(value)


def rows_of(frame) -> list[tuple]:
    cols = sorted(frame.columns)
    return sorted((tuple(plain(v) for v in row) for row in frame[cols].itertuples(index=False, name=None)), key=repr)


def compare(spark_df, con, sql: str) -> str:
    """'' when equal, else what differs."""
    mine, theirs = spark_df.toPandas(), con.execute(sql).df()
    if sorted(mine.columns) != sorted(theirs.columns):
        return f"columns {sorted(mine.columns)} != {sorted(theirs.columns)}"
    a, b = rows_of(mine), rows_of(theirs)
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(bad)} of {len(a)} rows differ, columns {sorted(mine.columns)}: {bad[:3]}" if bad else ""


def main() -> None:
    from tests.session import make_session
    from __spark_entry__ import oracle_sql, queries

    sf_dir, wanted = sys.argv[1], sys.argv[2:]
    spark, con, sqls, failed = make_session(), connect(sf_dir), oracle_sql(), []
    for name, fn in queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            if name in sqls:
                out = fn(spark, sf_dir)
                note = compare(out, con, sqls[name]) or f"ok {out.count() if wanted else ''}"
            else:
                note = f"rows only: {len(fn(spark, sf_dir).toPandas())}"
        except Exception as e:
            note = f"ERROR {type(e).__name__}: {str(e)[:1500]}"
        if not note.startswith(("ok", "rows only")):
            failed.append(name)
        print(f"{name:28s} {time.time() - start:6.2f}s {note}", flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main()
