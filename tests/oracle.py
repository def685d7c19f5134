"""Compares queries with their SQL on DuckDB."""

from __future__ import annotations

import os
from pathlib import Path

import duckdb

DATA = os.environ.get("LODESTAR_TESTDATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect():
    c = duckdb.connect()
    for t in TABLES:
        if Path(f"{DATA}/{t}.parquet").exists():
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def rows(frame):
    cols = sorted(frame.columns)
    return cols, sorted(map(repr, frame[cols].astype(object).where(frame[cols].notna(), None).values.tolist()))


def assert_equal(spark, query, sql):
    want = rows(connect().execute(sql).df())
    assert rows(query(spark, DATA).toPandas()) == want
