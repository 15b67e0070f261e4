import pytest

from echofold.llm.oracle import oracle_sql
from echofold.llm.queries import queries
from tests.compare import SF, needs_tables, same


@needs_tables
@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_with_sql(spark, name):
    same(spark, queries()[name], oracle_sql()[name])


@needs_tables
@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracle_sql())))
def test_query_without_sql(spark, name):
    df = queries()[name](spark, SF)
    assert df.count() > 0
    if name.endswith("_found"):
        assert df.distinct().count() == df.count()
