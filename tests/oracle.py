"""Comparison of a registered query with its checking SQL, row by row."""

from __future__ import annotations

import datetime
import decimal
import math

GIVEN = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def connect(folder: str):
    import duckdb

    db = duckdb.connect()
    for name in GIVEN:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return db


def plain(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float) and math.isnan(value):
        return "nan"
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


def _sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    table = [tuple(plain(row[i]) for i in order) for row in rows]
    return [columns[i] for i in order], sorted(table, key=repr)


def compare(df, db, sql: str) -> str:
    """Empty when both give the same rows, otherwise what differs first."""
    got_columns, got = _sorted_rows(df.columns, df.collect())
    relation = db.execute(sql)
    want_columns, want = _sorted_rows([d[0] for d in relation.description], relation.fetchall())
    if got_columns != want_columns:
        return f"columns {got_columns} instead of {want_columns}"
    if len(got) != len(want):
        extra = [g for g in got if g not in set(want)][:2] if len(got) < 5000 else ""
        return f"{len(got)} rows instead of {len(want)} {str(extra)[:600]}"
    wrong = [(g, w) for g, w in zip(got, want) if g != w]
    if wrong:
        return f"{len(wrong)} of {len(got)} rows differ, first {str(wrong[0])[:1500]}"
    types = [
        (c, type(g), type(w))
        for c, g, w in zip(got_columns, *(next(iter(r), ()) for r in (got, want)))
        if type(g) is not type(w)
    ]
    return f"types {types}" if types else ""
