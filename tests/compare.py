"""A query's rows and its SQL's rows, brought to one form and compared."""

from __future__ import annotations

import math
import os


def _value(x):
    if x is None:
        return None
    if isinstance(x, bool) or type(x).__name__ == "bool_":
        return bool(x)
    if isinstance(x, float):
        return None if math.isnan(x) else f"{x:.5f}"
    if isinstance(x, (list, tuple)):
        return [_value(v) for v in x]
    if type(x).__name__ == "Decimal":
        return f"{float(x):.5f}" if x % 1 else int(x)
    return str(x) if hasattr(x, "isoformat") else x


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return [columns[k] for k in order], sorted(repr([_value(r[k]) for k in order]) for r in data)


def duck(sf_dir, sql):
    import duckdb

    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(sf_dir):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{sf_dir}/{f}')")
    got = c.execute(sql)
    return rows([x[0] for x in got.description], got.fetchall())


def differences(df, sf_dir, sql):
    """None if both give the same rows, else what differs."""
    a, b = rows(df.columns, [tuple(r) for r in df.collect()]), duck(sf_dir, sql)
    if a[0] != b[0]:
        return f"columns {a[0]} and {b[0]}"
    if a[1] != b[1]:
        x, y = sorted(set(a[1]) - set(b[1]))[:2], sorted(set(b[1]) - set(a[1]))[:2]
        return f"{len(a[1])} and {len(b[1])} rows; only in ours {str(x)[:300]}, only in SQL {str(y)[:300]}"
    return None
