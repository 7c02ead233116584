"""Runs a query and its SQL twin and compares them: columns by name, rows in any order, values as they are."""

from __future__ import annotations

import math

import duckdb

from coppice.plans.common import TABLES


def connect(sf_dir: str):
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _canon(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return f"f{value + 0.0!r}"
    if isinstance(value, bool):
        return f"b{value}"
    if isinstance(value, (list, tuple)):
        return [_canon(v) for v in value]
    return f"{type(value).__name__}:{value}"


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([_canon(r[i]) for i in order]) for r in rows)


def compare(spark, con, fn, sql, sf_dir):
    """Returns (row count, list of problems)."""
    df = fn(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    rel = con.sql(sql)
    want = rows_of(rel.columns, rel.fetchall())
    problems = []
    if sorted(df.columns) != sorted(rel.columns):
        problems.append(f"columns {sorted(df.columns)} vs {sorted(rel.columns)}")
    if len(got) != len(want):
        problems.append(f"rows {len(got)} vs {len(want)}")
    if got != want:
        extra, missing = list(set(got) - set(want))[:2], list(set(want) - set(got))[:2]
        problems.append(f"spark only {extra} | oracle only {missing}")
    return len(got), problems
