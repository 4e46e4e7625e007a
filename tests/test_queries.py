import pytest

from inkweave import plans
from tests.compare import check

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_query_equals_duckdb(spark, name):
    check(plans.QUERIES[name](spark, SF), plans.ORACLES[name], SF)


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLES)))
def test_query_runs(spark, name):
    assert plans.QUERIES[name](spark, SF).count() >= 0
