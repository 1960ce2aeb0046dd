"""Run a query against its SQL in DuckDB on the driver's tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import numpy as np

DATA = Path("/root/testdata")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA / sf / t}.parquet'")
    return c


def plain(v):
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(plain(x) for x in v)
    if isinstance(v, bool | np.bool_):
        return bool(v)
    if isinstance(v, (int, float, np.number)) or type(v).__name__ == "Decimal":
        v = float(v)
        return None if math.isnan(v) else round(v, 6)
    return v


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in values), key=repr)


def compare(spark, name, query, sql, sf="sf0.001"):
    df = query(spark, str(DATA / sf))
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    c = connect(sf).execute(sql)
    names = [d[0] for d in c.description]
    assert sorted(names) == sorted(df.columns), name
    assert got == rows(names, c.fetchall()), name
