import pytest
from compare import same

from docloom.plans import queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_as_in_sql(spark, duck, data, name):
    same(queries.QUERIES[name](spark, data), duck.execute(queries.SQL[name]))


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_runs(spark, data, name):
    assert queries.QUERIES[name](spark, data).count() > 0


def test_entry_has_every_query(spark):
    import __spark_entry__ as e

    assert set(queries.QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
