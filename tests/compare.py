"""Run a query and its SQL on the same tables and compare names, row counts and values."""

from __future__ import annotations

import datetime
import math
from pathlib import Path

import duckdb


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v if math.isinf(v) else round(v, 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if hasattr(v, "as_tuple"):
        return round(float(v), 6)
    return tuple(map(_plain, v)) if isinstance(v, (list, tuple)) else v


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in Path(folder).glob("*.parquet"):
        source = f"{p}/*.parquet" if p.is_dir() else p
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{source}'")
    return con


def rows_of(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def differences(df, con, sql: str) -> str:
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    result = con.execute(sql)
    names = [x[0] for x in result.description]
    want = rows_of(names, result.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    if got == want:
        return ""
    some = [(a, b) for a, b in zip(got, want) if a != b][:3]
    return f"rows {len(got)} and {len(want)}; {some}"
