"""Rows of a query and of its SQL, in one comparable form."""

from __future__ import annotations

from pathlib import Path

import duckdb


def tables(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def normal(rows) -> list[tuple[str, ...]]:
    return sorted(tuple(f"{v:.9g}" if isinstance(v, float) else str(v) for v in row) for row in rows)


def differences(df, con, sql: str) -> tuple[list, list]:
    """Rows that only the query and that only the SQL gives."""
    columns = sorted(df.columns)
    got = normal(tuple(r) for r in df.select(*columns).collect())
    answer = con.execute(sql)
    names = [d[0] for d in answer.description]
    assert sorted(names) == columns
    want = normal(tuple(row[names.index(c)] for c in columns) for row in answer.fetchall())
    if got == want:
        return [], []
    a, b = set(got), set(want)
    return sorted(a - b)[:3] or ["other multiplicity"], sorted(b - a)[:3]
