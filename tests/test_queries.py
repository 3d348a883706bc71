"""Every registered query against its SQL, over whole tables."""

import pytest

from quire.plans import catalogue
from tests.oracle import compare


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_against_sql(spark, name):
    query = catalogue.QUERIES[name]
    assert query.sql and compare(spark, "/root/testdata/sf0.01", query.run, query.sql) > 0
