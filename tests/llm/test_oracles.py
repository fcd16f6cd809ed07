import pytest
from oracle import both

from quarryline.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, sf_dir, name):
    got, want = both(spark, sf_dir, queries.QUERIES[name], queries.ORACLES[name])
    assert got == want and got
