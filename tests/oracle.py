"""Compares a query's rows with its SQL's rows in DuckDB."""

from __future__ import annotations

import os

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def rows(columns: list[str], found: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    tidy = lambda v: f"{v:.6f}" if isinstance(v, float) else str(v)
    return sorted(tuple(tidy(r[i]) for i in order) for r in found)


def differences(df, con: duckdb.DuckDBPyConnection, query: str) -> str:
    mine = rows(df.columns, [tuple(r) for r in df.collect()])
    result = con.execute(query)
    names = [d[0] for d in result.description]
    theirs = rows(names, result.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    if mine != theirs:
        extra, missing = sorted(set(mine) - set(theirs))[:2], sorted(set(theirs) - set(mine))[:2]
        return f"{len(mine)} and {len(theirs)} rows; only here {str(extra)[:400]}; only there {str(missing)[:400]}"
    return "" if mine else "no rows"
