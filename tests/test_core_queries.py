import pytest
from oracle import both

from quarryline.plans import catalog

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_matches_sql(spark, name):
    got, want = both(spark, SMALL, catalog.QUERIES[name], catalog.ORACLES[name])
    assert got == want


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLES)
