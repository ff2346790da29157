import pytest

from symloom.plans import parsed  # noqa: F401
from symloom.plans.queries import QUERIES, SQL
from tests.oracle import difference


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_its_sql(spark, name):
    assert difference(spark, QUERIES[name], SQL[name], "/root/testdata/sf0.001") == ""
