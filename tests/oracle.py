"""Run a query and its SQL twin and compare names, row counts and values."""

from __future__ import annotations

import math
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def duck(folder: str):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(
            f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')"
        )
    return connection


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    if isinstance(value, bool):
        return int(value)
    return value


def bag(columns: list[str], rows) -> tuple[list[str], Counter]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    counted = Counter(tuple(_plain(row[i]) for i in order) for row in rows)
    return [columns[i] for i in order], counted


def difference(df, connection, sql: str) -> str | None:
    """None if both sides agree, else what differs."""
    got_names, got = bag(df.columns, [tuple(r) for r in df.collect()])
    result = connection.execute(sql)
    names = [d[0] for d in result.description]
    want_names, want = bag(names, result.fetchall())
    if got_names != want_names:
        return f"columns {got_names} != {want_names}"
    if got != want:
        extra, missing = got - want, want - got
        return (
            f"rows {sum(got.values())} vs {sum(want.values())}; "
            f"{sum(extra.values())} extra such as {list(extra)[:2]}; "
            f"{sum(missing.values())} missing such as {list(missing)[:2]}"
        )
    return None
