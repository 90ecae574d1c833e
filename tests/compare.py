"""Rows of a query against those of its SQL."""

import os
from collections import Counter
from pathlib import Path

import duckdb

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(value):
    if isinstance(value, float):
        return round(value, 9)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def both(spark, query, sql, folder=SF):
    """Columns and rows of either side, columns by name."""
    frame = query(spark, str(folder))
    names = sorted(frame.columns)
    ours = Counter(tuple(plain(v) for v in r) for r in frame.select(*names).collect())
    db = duckdb.connect()
    for table in Path(folder).glob("*.parquet"):
        db.execute(f"CREATE VIEW {table.stem} AS SELECT * FROM '{table}'")
    result = db.execute(sql)
    got = [d[0] for d in result.description]
    order = [got.index(n) for n in names] if sorted(got) == names else None
    theirs = Counter(tuple(plain(r[i]) for i in order) for r in result.fetchall()) if order is not None else got
    return ours, theirs
