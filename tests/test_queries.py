"""Every registered query against its SQL on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from loomery.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    return None if value is None or (isinstance(value, float) and math.isnan(value)) else round(value, 7) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(spark, sf, name):
    for t in TABLES:
        duckdb.sql(f"CREATE OR REPLACE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    ours = registry.queries()[name](spark, sf)
    columns = sorted(ours.columns)
    theirs = duckdb.sql(registry.oracle_sql()[name])
    assert sorted(theirs.columns) == columns
    at = [theirs.columns.index(c) for c in columns]
    assert sorted(str([plain(r[c]) for c in columns]) for r in ours.collect()) == sorted(str([plain(r[i]) for i in at]) for r in theirs.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() == 1


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_without_sql(spark, sf, name):
    assert registry.queries()[name](spark, sf).count() > 0
