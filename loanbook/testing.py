"""Oracle harness: run a Spark query and its SQL twin and compare results.

Comparison is order-insensitive: columns sorted by name, rows sorted,
doubles rounded to a fixed number of decimals before comparing.
"""

from __future__ import annotations

import math

import duckdb
import pandas as pd
from pyspark.sql import DataFrame

from loanbook.sources.tables import TABLES


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir.rstrip('/')}/{t}.parquet')")
    return con


def _norm(v, digits):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return v if digits is None else round(v, digits)
    if hasattr(v, "isoformat"):
        s = v.isoformat()
        return s[:10] if s.endswith("T00:00:00") or len(s) == 10 else s
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x, digits) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x, digits)) for k, x in v.items()))
    try:
        import numpy as np
        if isinstance(v, np.generic):
            return _norm(v.item(), digits)
    except ImportError:  # pragma: no cover
        pass
    return v


def rows_of(pdf: pd.DataFrame, digits: int = 6) -> list[tuple]:
    cols = sorted(pdf.columns)
    out = []
    for rec in pdf[cols].itertuples(index=False, name=None):
        out.append(tuple(_norm(x, digits) for x in rec))
    return sorted(out, key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


def compare(df: DataFrame, sql: str, sf_dir: str, digits: int = 6) -> dict:
    left = df.toPandas()
    con = duck(sf_dir)
    right = con.execute(sql).fetchdf()
    res = {"rows_spark": len(left), "rows_sql": len(right),
           "cols_spark": sorted(left.columns), "cols_sql": sorted(right.columns)}
    res["schema_ok"] = res["cols_spark"] == res["cols_sql"]
    res["rows_ok"] = len(left) == len(right)
    ok = res["schema_ok"] and res["rows_ok"]
    if ok:
        a, b = rows_of(left, digits), rows_of(right, digits)
        bad = [(x, y) for x, y in zip(a, b) if x != y]
        res["value_ok"] = not bad
        res["first_diff"] = bad[:2]
    else:
        res["value_ok"] = False
    res["ok"] = ok and res["value_ok"]
    return res
