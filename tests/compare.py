"""Compare a Spark result with the SQL result on the same tables."""

import math
from pathlib import Path

import duckdb


def oracle_rows(sql: str, sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    cursor = con.execute(sql)
    return [c[0] for c in cursor.description], cursor.fetchall()


def _key(row):
    return tuple((v is None, str(type(v)), v if v is not None else 0) for v in row)


def _plain(value):
    return float(f"{value:.12g}") if isinstance(value, float) and math.isfinite(value) else value


def difference(df, sql: str, sf_dir: str) -> str | None:
    """None when both hold the same columns and rows, else what differs."""
    names, expected = oracle_rows(sql, sf_dir)
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    order = sorted(names)
    ours = [tuple(_plain(row[n]) for n in order) for row in df.collect()]
    theirs = [tuple(_plain(row[names.index(n)]) for n in order) for row in expected]
    ours.sort(key=_key), theirs.sort(key=_key)
    if len(ours) != len(theirs):
        return f"rows {len(ours)} != {len(theirs)}"
    for a, b in zip(ours, theirs):
        if a != b:
            return f"first difference:\n{dict(zip(order, a))}\n{dict(zip(order, b))}"
    return None
