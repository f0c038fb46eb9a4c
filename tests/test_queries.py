"""Every registered query against its SQL, on the smallest tables."""

import pytest
from compare import same

import __spark_entry__ as entry
from pointloom import catalog


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_sql(spark, sf, duck, name):
    same(catalog.queries()[name](spark, sf), duck, catalog.oracle_sql()[name])


def test_queries_without_sql_run(spark, sf):
    for name in set(catalog.queries()) - set(catalog.oracle_sql()):
        assert catalog.queries()[name](spark, sf).count() > 0


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["vx", "vy", "vz", "n", "x", "y", "z"] and df.count() > 0


def test_all_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
