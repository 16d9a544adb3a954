"""Compare a registered Spark query with its DuckDB oracle SQL.

Same checks as the driver's correctness gate: row count, column names, and an
order-insensitive hash of the values with columns sorted by name.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import math

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET timezone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def value_hash(columns: list[str], rows: list[tuple]) -> str:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    keyed = sorted(repr(tuple(_norm(row[i]) for i in order)) for row in rows)
    return hashlib.sha256("\n".join(keyed).encode()).hexdigest()


def compare(spark, con, name: str, build, sql: str, sf_dir: str) -> dict:
    sdf = build(spark, sf_dir)
    s_cols = sdf.columns
    s_rows = [tuple(r) for r in sdf.collect()]
    rel = con.sql(sql)
    d_cols = list(rel.columns)
    d_rows = rel.fetchall()
    out = {
        "name": name,
        "spark_rows": len(s_rows), "duck_rows": len(d_rows),
        "cols_match": sorted(s_cols) == sorted(d_cols),
        "hash_match": value_hash(s_cols, s_rows) == value_hash(d_cols, d_rows),
    }
    if not out["cols_match"]:
        out["spark_cols"], out["duck_cols"] = s_cols, d_cols
    out["ok"] = out["spark_rows"] == out["duck_rows"] and out["cols_match"] and out["hash_match"]
    return out
