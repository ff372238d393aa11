"""Every registered query of the library against its SQL."""

import pytest

from ledgerwatch.plans import detection, monitoring, scores

from .oracle import assert_same

SF = "/root/testdata/sf0.001"
QUERIES = detection.QUERIES | monitoring.QUERIES | scores.QUERIES
ORACLES = detection.ORACLES | monitoring.ORACLES | scores.ORACLES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, name):
    assert_same(QUERIES[name](spark, SF), ORACLES[name], SF)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_without_sql_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
