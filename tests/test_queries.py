"""Every query of the core against its SQL; those without SQL run."""

import pytest

import __spark_entry__ as e
from lakeweave.plans import index_queries, lake_queries, skew_queries

CORE = [m for m in (lake_queries, index_queries, skew_queries)]
WITH_SQL = [n for m in CORE for n in m.ORACLES]
WITHOUT = [n for m in CORE for n in m.QUERIES if n not in m.ORACLES]


@pytest.mark.parametrize("name", WITH_SQL)
def test_against_sql(against_sql, name):
    against_sql(name)


@pytest.mark.parametrize("name", WITHOUT)
def test_runs(spark, sf_dir, name):
    assert e.queries()[name](spark, sf_dir).count() > 0


def test_entry(spark):
    assert e.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(e.oracle_sql()) <= set(e.queries())
