"""Compare a Spark result with a DuckDB result: same columns, same multiset of rows."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for t in TABLES:
        p = Path(sf_dir, f"{t}.parquet")
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return db


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, int):
        return float(v)
    if hasattr(v, "isoformat"):
        return v.isoformat()[:26].replace("+00:00", "")
    return type(v).__name__ == "Decimal" and float(v) or (v if type(v).__name__ != "Decimal" else 0.0)


def differences(df, db: duckdb.DuckDBPyConnection, sql: str) -> str:
    cur = db.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    order = sorted(names)
    theirs = Counter(tuple(plain(r[names.index(c)]) for c in order) for r in cur.fetchall())
    own = Counter(tuple(plain(r[c]) for c in order) for r in df.collect())
    if own == theirs:
        return "" if own else "both are empty"
    return f"{order}: {sum(own.values())} and {sum(theirs.values())} rows; only Spark {list((own - theirs).items())[:2]}; only DuckDB {list((theirs - own).items())[:2]}"
