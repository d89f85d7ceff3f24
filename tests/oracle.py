"""Comparison of a query with its SQL: rows as sorted tuples, doubles to nine places."""

from __future__ import annotations

import math


def plain(value):
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return repr(round(value, 9) + 0.0) if math.isfinite(value) else str(value)
    if isinstance(value, list | tuple):
        return "[" + ",".join(map(plain, value)) + "]"
    return str(value)


def agree(spark, duck, data, query, sql) -> None:
    df = query(spark, data)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    want = duck.sql(sql)
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert got == sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())
