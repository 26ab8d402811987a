import os

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_every_query_runs(spark, name):
    df = entry.queries()[name](spark, DATA)
    assert df.columns and len(set(df.columns)) == len(df.columns)
    df.write.format("noop").mode("overwrite").save()


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_flagship(spark):
    assert entry.entry(spark).count() > 0
