"""Queries of the subpackage that SQL can express, against it."""

from __future__ import annotations

import duckdb
import pytest

from glyphmill.llm import queries as training

TABLES = "documents embeddings pages benchmark labels conversations".split()


@pytest.mark.parametrize("name", sorted(training.oracle_sql()))
def test_equals_sql(spark, sf, name):
    duck = duckdb.connect()
    for table in TABLES:
        duck.sql(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf}/{table}.parquet')")
    got, want = training.queries()[name](spark, sf).toPandas(), duck.sql(training.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda d: sorted(tuple(repr(float(v)) if isinstance(v, float) else str(v) for v in r) for r in d[sorted(d.columns)].itertuples(index=False))
    assert rows(got) == rows(want)
