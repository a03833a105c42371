import pytest
from oracle import same

from shopsift.plans.catalogue import QUERIES, SQL

SF = "/root/testdata/sf0.001"


def test_every_query_has_sql():
    assert QUERIES.keys() == SQL.keys()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, name):
    same(spark, SF, QUERIES[name], SQL[name])
