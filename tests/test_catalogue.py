"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import glob
import math
import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry_points

SMALL = "/root/testdata/sf0.001"
QUERIES = entry_points.queries()
CHECKS = entry_points.oracle_sql()


@pytest.fixture(scope="module")
def reference_engine():
    connection = duckdb.connect()
    for path in glob.glob(f"{SMALL}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    yield connection
    connection.close()


def plain(value):
    return None if isinstance(value, float) and math.isnan(value) else value


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, reference_engine, name):
    df = QUERIES[name](spark, SMALL)
    columns = sorted(df.columns)
    got = Counter(tuple(plain(v) for v in row) for row in df.select(*[f"`{c}`" for c in columns]).collect())
    if name not in CHECKS:
        assert got
        return
    result = reference_engine.execute(CHECKS[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert got == Counter(tuple(plain(row[i]) for i in order) for row in result.fetchall())


def test_every_check_belongs_to_a_query():
    assert set(CHECKS) <= set(QUERIES)
