"""Rows of a Spark query and of DuckDB SQL over the same tables, made comparable."""

from __future__ import annotations

import datetime as dt
import math
from pathlib import Path

import duckdb


def duck(sf_dir: str):
    con = duckdb.connect()
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None)
    if hasattr(value, "as_tuple"):
        return round(float(value), 6)
    return value


def rows(names: list[str], data) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=lambda r: tuple((x is not None, str(type(x)), str(x)) for x in r))
