"""Every registered query of the store against its SQL, and the entry point."""

from pathlib import Path

import pytest
from oracle import same_rows

from kvspark.plans.queries import Q

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not Path(DATA).is_dir(), reason="no test tables")


@needs_data
@pytest.mark.parametrize("name", [n for n, (_, sql) in Q.items() if sql])
def test_same_as_sql(spark, name):
    query, sql = Q[name]
    same_rows(query, sql, spark, DATA)


@needs_data
@pytest.mark.parametrize("name", [n for n, (_, sql) in Q.items() if not sql])
def test_has_rows(spark, name):
    assert Q[name][0](spark, DATA).count() > 0


@needs_data
def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns
    assert set(e.oracle_sql()) <= set(e.queries())
