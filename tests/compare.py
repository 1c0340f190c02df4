"""Compare a Spark result with DuckDB's, regardless of row order."""

from __future__ import annotations

import math
from collections import Counter

import duckdb

from pricewright.sources.tables import SCHEMAS

KINDS = {"int": "INTEGER", "boolean": "BOOLEAN", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE", "timestamp_ntz": "TIMESTAMP"}


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in SCHEMAS:
        con.execute(f"create view {name} as select * from read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _key(value):
    if isinstance(value, float):
        return float("nan") if math.isnan(value) else round(value, 9) + 0.0
    return value


def differences(df, con, sql: str) -> list[str]:
    """What differs, as text; empty when the results are the same."""
    expected = con.sql(sql)
    names = sorted(df.columns)
    if names != sorted(expected.columns):
        return [f"columns {names} and {sorted(expected.columns)}"]
    found = []
    kinds = dict(zip(expected.columns, map(str, expected.types)))
    for name, kind in df.dtypes:
        if KINDS.get(kind) != kinds[name]:
            found.append(f"type of {name}: {kind} and {kinds[name]}")
    mine = Counter(tuple(_key(r[n]) for n in names) for r in df.collect())
    order = [expected.columns.index(n) for n in names]
    theirs = Counter(tuple(_key(r[i]) for i in order) for r in expected.fetchall())
    if mine != theirs:
        found.append(f"rows {mine.total()} and {theirs.total()}")
        found.append(f"only in Spark: {list((mine - theirs).items())[:3]}")
        found.append(f"only in SQL: {list((theirs - mine).items())[:3]}")
    return found
