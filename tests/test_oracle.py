"""Every registered query against its DuckDB oracle on the sf0.001 tables
(the driver runs the same comparison at sf0.01)."""

import pytest

import __spark_entry__ as E
from tests.oracle_compare import compare
from tillwise import registry

ORACLE = registry.oracle()
QUERIES = {n: E.queries()[n] for n in registry.QUERIES}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, duck_small, name):
    ok, msg = compare(QUERIES[name](spark, "/root/testdata/sf0.001"), duck_small, ORACLE[name])
    assert ok, msg


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["category_name", "units", "revenue"]
    assert df.count() > 0
