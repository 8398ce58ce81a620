"""Compare a query's rows with its SQL in DuckDB over the same Parquet files."""

from __future__ import annotations

from pathlib import Path

import duckdb


def oracle_rows(sf_dir: str, sql: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    found = con.execute(sql)
    return [d[0] for d in found.description], found.fetchall()


def same_rows(df, sf_dir: str, sql: str) -> None:
    names, expected = oracle_rows(sf_dir, sql)
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    plain = lambda v: repr(float(v)) if isinstance(v, float) else str(v)
    got = sorted(tuple(plain(r[c]) for c in order) for r in df.collect())
    want = sorted(tuple(plain(r[names.index(c)]) for c in order) for r in expected)
    assert got == want
