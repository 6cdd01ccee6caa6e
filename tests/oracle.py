"""Compares a Spark result with DuckDB SQL over the same Parquet tables."""

from __future__ import annotations

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str, sql: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con.execute(sql).df()


def normal(frame) -> list[tuple]:
    """Rows as sorted tuples of text; columns by name."""
    frame = frame[sorted(frame.columns)]

    def text(x) -> str:
        if x is None or str(x) in ("NaT", "<NA>", "nan"):
            return ""
        if isinstance(x, bool) or type(x).__name__ == "bool_":
            return str(bool(x))
        if isinstance(x, (int, float)) or type(x).__module__ == "numpy" and getattr(x, "ndim", 1) == 0 and x.dtype.kind in "iuf":
            return repr(round(float(x), 6) + 0.0) if abs(x) < 2**53 else str(x)
        if hasattr(x, "tolist"):
            x = x.tolist()
        if isinstance(x, list):
            return "[" + ",".join(map(text, x)) + "]"
        return str(x).removesuffix(" 00:00:00")

    return sorted(tuple(map(text, row)) for row in frame.itertuples(index=False, name=None))


def differences(spark_frame, duck_frame) -> str:
    if sorted(spark_frame.columns) != sorted(duck_frame.columns):
        return f"columns {sorted(spark_frame.columns)} and {sorted(duck_frame.columns)}"
    a, b = normal(spark_frame), normal(duck_frame)
    if a == b:
        return ""
    left, right = set(a), set(b)
    only, other = sorted(left - right)[:3], sorted(right - left)[:3]
    return f"{len(a)} and {len(b)} rows; columns {sorted(spark_frame.columns)}; only Spark {only}; only DuckDB {other}"
