import pytest

from glossweave.plans import bridging, dictionaries, evaluation  # noqa: F401
from glossweave.plans.queries import QUERIES, SQL
from tests.compare import both

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, name, sf):
    mine, other = both(spark, QUERIES[name], SQL[name], f"/root/testdata/{sf}")
    assert mine[0] == other[0]
    assert len(mine[1]) == len(other[1]) > 0
    assert mine[1] == other[1]


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
