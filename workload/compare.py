"""Runs the registered queries against their SQL in DuckDB: python -m workload.compare [sf] [query ...]"""

from __future__ import annotations

import sys
import time

import duckdb
import pandas as pd

from plumbline.session import local_session
from workload.oracle import ORACLES
from workload.queries import QUERIES
from workload.views import TABLES


def rows_of(frame: pd.DataFrame) -> list[str]:
    frame = frame[sorted(frame.columns)]
    return sorted("|".join("NULL" if pd.isna(v) else str(v) for v in row) for row in frame.itertuples(index=False))


def duckdb_views(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def main() -> int:
    sf = sys.argv[1] if len(sys.argv) > 1 else "sf0.01"
    chosen = sys.argv[2:] or list(QUERIES)
    directory = f"/root/testdata/{sf}"
    spark, con, failed = local_session(8), duckdb_views(directory), []
    for name in chosen:
        start = time.time()
        try:
            ours = QUERIES[name](spark, directory).toPandas()
            took = time.time() - start
            theirs = con.execute(ORACLES[name]).df()
            if sorted(ours.columns) != sorted(theirs.columns):
                verdict = f"COLUMNS {sorted(ours.columns)} {sorted(theirs.columns)}"
            else:
                a, b = rows_of(ours), rows_of(theirs)
                differing = [(x, y) for x, y in zip(a, b) if x != y][:2]
                verdict = "ok" if a == b else f"DIFFER {len(a)} {len(b)} {differing}"
        except Exception as e:  # noqa: BLE001 - report and go on
            took, verdict = time.time() - start, f"ERROR {type(e).__name__}: {str(e)[:600]}"
        if verdict != "ok":
            failed.append(name)
        print(f"{name:24s}{took:7.2f}s {verdict}", flush=True)
    print("failed:", failed)
    return len(failed)


if __name__ == "__main__":
    sys.exit(main())
