"""Holds a query's rows against those of its SQL, run by another engine over the same tables."""

from __future__ import annotations

import math
import os
from datetime import date, datetime
from decimal import Decimal
from pathlib import Path

import duckdb

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9) + 0.0
    if isinstance(v, Decimal):
        return float(v)
    if isinstance(v, datetime | date):
        return v.isoformat()
    if isinstance(v, int | str):
        return v
    if isinstance(v, list | tuple):
        return tuple(map(plain, v))
    return str(v)


def rows_of(rows, names) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    found = [tuple(plain(r[i]) for i in order) for r in rows]
    return sorted(found, key=lambda r: tuple((x is not None, str(type(x)), x) if not isinstance(x, tuple) else (True, "t", str(x)) for x in r))


def connect(folder: str = DATA):
    con = duckdb.connect()
    con.execute("set threads to 2")
    for p in sorted(Path(folder).glob("*.parquet")):
        con.execute(f"create view {p.stem} as select * from '{p if p.is_file() else f'{p}/*.parquet'}'")
    return con


def differences(df, sql: str, con) -> str:
    """"" if both give the same columns, kinds and rows; else what differs."""
    names = df.columns
    got = rows_of(df.collect(), names)
    found = con.execute(sql)
    their_names = [d[0] for d in found.description]
    if sorted(names) != sorted(their_names):
        return f"columns {sorted(names)} / {sorted(their_names)}"
    want = rows_of(found.fetchall(), their_names)
    if len(got) != len(want):
        only = list(dict.fromkeys(x for x in got if x not in set(want)))[:2], list(dict.fromkeys(x for x in want if x not in set(got)))[:2]
        return f"{len(got)} rows / {len(want)}; {only}"
    for a, b in zip(got, want, strict=True):
        if a != b or [type(x) for x in a] != [type(x) for x in b]:
            return f"{sorted(names)}: {a} / {b}"
    if not got:
        return "no rows on either side"
    return ""
