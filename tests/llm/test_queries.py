import pytest

from litspark.llm import queries
from tests import oracle


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_runs(spark, data, name):
    df = queries.QUERIES[name](spark, data)
    rows = df.collect()
    assert rows or name in ("p8_found",)
    if name in queries.ORACLE:
        oracle.same(oracle.connect(data), df, queries.ORACLE[name])
    if name.endswith("_found"):
        assert len(rows) == len(set(rows))
