import pytest

from ledgerwatch.llm import queries

from ..oracle import assert_same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_as_sql(spark, name):
    assert_same(queries.QUERIES[name](spark, SF), queries.ORACLES[name], SF)


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
