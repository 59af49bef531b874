"""Frames as sorted rows, for comparing engines."""

import os

import duckdb


def plain(value):
    if value is None:
        return None
    if hasattr(value, "asDict"):
        return {k: plain(v) for k, v in value.asDict().items()}
    if hasattr(value, "tolist"):
        value = value.tolist()
    if isinstance(value, dict):
        return {k: plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    if isinstance(value, float):
        return None if value != value else round(value, 6)
    return value


def rows(table, columns):
    return sorted(repr([plain(r[c]) for c in columns]) for r in table)


def oracle(sf_dir, sql):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.sql(f"create view {name.removesuffix('.parquet')} as select * from '{sf_dir}/{name}'")
    found = con.sql(sql)
    return [dict(zip(found.columns, r)) for r in found.fetchall()], found.columns


def assert_same(df, sf_dir, sql):
    want, columns = oracle(sf_dir, sql)
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.collect(), sorted(columns)) == rows(want, sorted(columns))
