import pytest

from echofold.plans.oracle import oracle_sql
from echofold.plans.queries import queries
from tests.compare import needs_tables, same


def test_every_query_has_sql():
    assert set(queries()) == set(oracle_sql())


@needs_tables
@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, name):
    same(spark, queries()[name], oracle_sql()[name])
