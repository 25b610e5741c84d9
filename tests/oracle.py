"""Comparison of a query with its SQL, as multisets of rows with columns sorted by name."""

from __future__ import annotations

import math
import os
from collections import Counter

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(x):
    if x is None or x is pd.NaT or isinstance(x, float) and math.isnan(x):
        return None
    if isinstance(x, float):
        return float(f"{x:.12g}") + 0.0
    if hasattr(x, "tolist") and not isinstance(x, (str, bytes)):
        x = x.tolist()
        return _plain(x)
    if isinstance(x, (list, tuple)):
        return tuple(map(_plain, x))
    if hasattr(x, "asDict"):
        return tuple(_plain(v) for v in x)
    if isinstance(x, dict):
        return tuple(_plain(v) for v in x.values())
    return x


def difference(spark, sf_dir, query, sql):
    """What differs: None, or a message."""
    df = query(spark, sf_dir)
    columns = sorted(df.columns)
    ours = Counter(tuple(_plain(r[c]) for c in columns) for r in df.collect())
    connection = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    found = connection.sql(sql)
    names = found.columns
    if sorted(names) != columns:
        return f"columns {columns} and {sorted(names)}"
    order = [names.index(c) for c in columns]
    theirs = Counter(tuple(_plain(r[i]) for i in order) for r in found.fetchall())
    if ours == theirs:
        return None
    return f"rows {sum(ours.values())} and {sum(theirs.values())}; only ours {list((ours - theirs).items())[:2]}; only theirs {list((theirs - ours).items())[:2]}"
