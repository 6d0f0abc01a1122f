"""Runs registered queries beside their SQL in DuckDB and compares all rows."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path


def _plain(x):
    if isinstance(x, float) and math.isfinite(x):
        return round(x, 6)
    return x


def mismatch(frame, sql: str, sf_dir: str) -> str | None:
    """What differs between a Spark result and the SQL's, or None."""
    import duckdb

    c = duckdb.connect()
    for f in Path(sf_dir).glob("*.parquet"):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    names = sorted(frame.columns)
    got = Counter(tuple(map(_plain, r)) for r in frame.select(*(f"`{n}`" for n in names)).collect())
    quoted = ", ".join(f'"{n}"' for n in names)
    want = Counter(tuple(map(_plain, r)) for r in c.execute(f"SELECT {quoted} FROM ({sql}) q").fetchall())
    if got != want:
        return f"{sum(got.values())} rows, {sum(want.values())} by SQL; only here {list((got - want))[:3]}, only there {list((want - got))[:3]}; {names}"
    return None if got else "no rows"
