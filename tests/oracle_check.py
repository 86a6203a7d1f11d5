"""Run registered queries against their SQL checks in DuckDB.

``python tests/oracle_check.py <data folder> [name ...]`` prints one line per query.
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(root: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{root}/{t}.parquet'")
    return con


def normal(value):
    if value is None:
        return None
    if isinstance(value, float):
        return None if math.isnan(value) else round(value + 0.0, 6)
    return value


def as_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(normal(row[i]) for i in order) for row in rows), key=repr)


def compare(con, df, text: str):
    """None when equal, else a description of the difference."""
    cursor = con.execute(text)
    expected_columns = [d[0] for d in cursor.description]
    expected = as_rows(expected_columns, cursor.fetchall())
    if sorted(expected_columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(expected_columns)}"
    got = as_rows(df.columns, [tuple(r) for r in df.collect()])
    if len(got) != len(expected):
        return f"{len(got)} rows, expected {len(expected)}"
    bad = [(g, e) for g, e in zip(got, expected) if g != e]
    return f"{len(bad)} of {len(got)} rows differ, first {bad[0]}" if bad else None


def main(root: str, names: list[str]) -> int:
    from cohortgrid.plans import ORACLES, QUERIES
    from cohortgrid.session import local_session

    spark, con, failures = local_session(), connect(root), 0
    for name in names or QUERIES:
        start = time.time()
        try:
            df = QUERIES[name](spark, root)
            if name in ORACLES:
                problem = compare(con, df, ORACLES[name])
                verdict = problem or "match"
            else:
                problem, verdict = None, f"rows only: {df.count()}"
        except Exception as error:  # report and go on with the next query
            problem = verdict = f"{type(error).__name__}: {str(error)[:600]}"
        failures += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - start:.1f}s {verdict}", flush=True)
    print(f"{failures} failures")
    return failures


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1], sys.argv[2:]) else 0)
