"""Run a catalogue query and its SQL twin on the same tables and compare."""

from __future__ import annotations

import datetime
import glob
import os
from collections import Counter

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if isinstance(value, float):
        return round(value, 9)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def as_bag(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(row[i]) for i in order) for row in rows)


def compare(spark, con, query, sql: str, sf_dir: str):
    """(rows, difference or None)."""
    got = query(spark, sf_dir)
    got_rows = got.collect()
    want = con.execute(sql)
    want_columns = [d[0] for d in want.description]
    want_rows = want.fetchall()
    if sorted(got.columns) != sorted(want_columns):
        return len(got_rows), f"columns {sorted(got.columns)} <> {sorted(want_columns)}"
    a, b = as_bag(got.columns, got_rows), as_bag(want_columns, want_rows)
    if a != b:
        return len(got_rows), (f"{len(got_rows)} rows against {len(want_rows)}; columns {sorted(want_columns)}; "
                               f"only spark {list((a - b).items())[:2]}; only sql {list((b - a).items())[:2]}")
    return len(got_rows), None
