"""Run the registered queries next to their SQL and compare row counts, columns and values.

    python tools/check.py [folder] [query ...]
"""

import sys
import time
import traceback
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from wattloom.plans import oracle, queries  # noqa: E402
from wattloom.runtime import local_session  # noqa: E402


def comparable(frame: pd.DataFrame) -> list[tuple]:
    """Rows with columns by name, doubles to 12 significant digits, sorted."""
    frame = frame[sorted(frame.columns)]

    def cell(v):
        if v is None or (isinstance(v, float) and v != v) or v is pd.NA or v is pd.NaT:
            return ""
        if isinstance(v, bool):
            return str(v)
        try:
            return f"{float(v) + 0.0:.12g}" if not isinstance(v, str) else v
        except (TypeError, ValueError):
            return str(v)

    return sorted(tuple(cell(v) for v in row) for row in frame.itertuples(index=False))


def compare(found: pd.DataFrame, connection, sql: str | None) -> str:
    if sql is None:
        return f"rows only ({len(found)})"
    wanted = connection.execute(sql).df()
    if sorted(found.columns) != sorted(wanted.columns):
        return f"DIFFERENT COLUMNS {sorted(found.columns)} / {sorted(wanted.columns)}"
    a, b = comparable(found), comparable(wanted)
    if len(a) != len(b):
        return f"DIFFERENT ROW COUNTS {len(a)} / {len(b)}"
    if a != b:
        bad = [(x, y) for x, y in zip(a, b) if x != y]
        return f"DIFFERENT VALUES in {len(bad)} of {len(a)} rows: {bad[0]}"
    return f"ok ({len(a)})"


def main(folder="/root/testdata/sf0.01", *names):
    spark = local_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    connection = duckdb.connect()
    for path in sorted(Path(folder).glob("*.parquet")):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    statements = oracle.statements()
    failed = []
    for name in names or queries.registered():
        started = time.time()
        try:
            found = queries.registered()[name](spark, folder).toPandas()
            result = compare(found, connection, statements.get(name))
        except Exception as error:
            traceback.print_exc(limit=3)
            result = f"ERROR {type(error).__name__}: {str(error)[:600]}"
        if not result.startswith(("ok", "rows only")):
            failed.append(name)
        print(f"{name:28s} {time.time() - started:6.2f}s  {result}", flush=True)
    print("failed:", failed or "none", "| unregistered:", set(statements) - set(queries.registered()))
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(*sys.argv[1:]))
