import pytest

from litspark import catalogue
from tests import oracle


@pytest.fixture(scope="module")
def duck(data):
    return oracle.connect(data)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_query_equals_sql(spark, data, duck, name):
    oracle.same(duck, catalogue.QUERIES[name](spark, data), catalogue.ORACLE[name])


def test_names_of_sql_are_queries():
    assert set(catalogue.ORACLE) <= set(catalogue.QUERIES)
