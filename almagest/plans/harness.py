"""Side-by-side check of a registered query against its DuckDB oracle,
comparing row count, column names and an order-insensitive value hash (the
same three things the driver records)."""

from __future__ import annotations

import datetime as dt
import hashlib
import math

import duckdb

from almagest.sources.tables import TABLES


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return float(f"{v:.9g}")
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if hasattr(v, "asDict"):
        return str(sorted(v.asDict(recursive=True).items()))
    if isinstance(v, dict):
        return str(sorted(v.items()))
    if isinstance(v, bool):
        return bool(v)
    if isinstance(v, int):
        return int(v)
    try:
        import decimal
        if isinstance(v, decimal.Decimal):
            return float(f"{float(v):.9g}")
    except Exception:
        pass
    return v


def _rows_spark(df):
    cols = sorted(df.columns)
    return cols, [tuple(_norm(r[c]) for c in cols) for r in df.collect()]


def _rows_duck(con, sql):
    rel = con.sql(sql)
    names = rel.columns
    cols = sorted(names)
    idx = [names.index(c) for c in cols]
    return cols, [tuple(_norm(r[i]) for i in idx) for r in rel.fetchall()]


def _hash(rows):
    h = hashlib.sha256()
    for r in sorted(repr(x) for x in rows):
        h.update(r.encode())
    return h.hexdigest()[:16]


def compare(spark, con, fn, sql, sf_dir):
    s_cols, s_rows = _rows_spark(fn(spark, sf_dir))
    d_cols, d_rows = _rows_duck(con, sql)
    out = {
        "rows_spark": len(s_rows), "rows_oracle": len(d_rows),
        "cols_match": s_cols == d_cols,
        "hash_match": s_cols == d_cols and _hash(s_rows) == _hash(d_rows),
    }
    if s_cols != d_cols:
        out["cols_spark"], out["cols_oracle"] = s_cols, d_cols
    elif not out["hash_match"]:
        a, b = set(s_rows), set(d_rows)
        out["only_spark"] = sorted(map(repr, a - b))[:3]
        out["only_oracle"] = sorted(map(repr, b - a))[:3]
    out["ok"] = out["hash_match"] and len(s_rows) == len(d_rows)
    return out
