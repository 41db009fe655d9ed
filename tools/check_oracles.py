"""Compare queries with their SQL in DuckDB: columns, types, row count and rows.

    python tools/check_oracles.py [--sf 0.01] [query ...]
"""

from __future__ import annotations

import argparse
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from winnow.plans import ORACLES, QUERIES  # noqa: E402
from winnow.session import local_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return connection


def compare(spark, connection, folder: str, name: str) -> str:
    """'' when equal, else what differs."""
    got = QUERIES[name](spark, folder).toArrow()
    want = connection.execute(ORACLES[name]).to_arrow_table()
    columns = sorted(want.column_names)
    if sorted(got.column_names) != columns:
        return f"columns {got.column_names} != {want.column_names}"
    got, want = got.select(columns), want.select(columns)
    notes = [
        f"{c}:{a}/{b}"
        for c, a, b in zip(columns, got.schema.types, want.schema.types, strict=True)
        if str(a).removeprefix("large_") != str(b).removeprefix("large_")
    ]
    if notes:
        return "types " + " ".join(notes)
    rows_got = sorted(map(repr, zip(*[c.to_pylist() for c in got.columns], strict=True)))
    rows_want = sorted(map(repr, zip(*[c.to_pylist() for c in want.columns], strict=True)))
    if rows_got == rows_want:
        return "" if rows_got else "no rows"
    extra = sorted(set(rows_got) - set(rows_want))[:2]
    lacking = sorted(set(rows_want) - set(rows_got))[:2]
    return f"rows {len(rows_got)}/{len(rows_want)} extra {str(extra)[:700]} lacking {str(lacking)[:700]}"


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("names", nargs="*")
    options = parser.parse_args()
    folder = f"/root/testdata/sf{options.sf}"
    spark = local_session(8)
    connection = connect(folder)
    failed = 0
    for name in options.names or QUERIES:
        started = time.time()
        try:
            if name in ORACLES:
                wrong = compare(spark, connection, folder, name)
            else:
                wrong = "" if QUERIES[name](spark, folder).count() else "no rows"
        except Exception as error:  # noqa: BLE001
            wrong = f"{type(error).__name__}: {str(error)[:1500]}"
        failed += bool(wrong)
        print(f"{'FAIL' if wrong else 'ok  '} {name} {time.time() - started:.1f}s {wrong}", flush=True)
    return failed


if __name__ == "__main__":
    sys.exit(main())
