"""Order-insensitive comparison of a Spark result with DuckDB's."""

from __future__ import annotations

import decimal


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (float, decimal.Decimal)):
        return None if v != v else round(float(v), 6)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(plain(x) for x in v.values())
    return v


def spark_rows(df):
    columns = sorted(df.columns)
    return columns, sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)


def duck_rows(con, sql):
    result = con.execute(sql)
    names = [c[0] for c in result.description]
    columns = sorted(names)
    at = [names.index(c) for c in columns]
    return columns, sorted((tuple(plain(r[i]) for i in at) for r in result.fetchall()), key=repr)


def assert_same(df, con, sql):
    columns, rows = spark_rows(df)
    twin_columns, twin = duck_rows(con, sql)
    assert columns == twin_columns
    assert rows == twin
