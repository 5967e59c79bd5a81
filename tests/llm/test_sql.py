import pytest
from compare import same

from docloom.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_as_in_sql(spark, duck, data, name):
    same(queries.QUERIES[name](spark, data), duck.execute(queries.ORACLE_SQL[name]))


def test_every_operator_has_a_query():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{i}" for i in range(1, 11)] + ["pipeline"]
