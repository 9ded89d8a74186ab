import pytest
from oracle import connect, same

from lodestone.plans import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_its_oracle(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    if name in ORACLES:
        same(df, con, ORACLES[name])
    else:
        assert df.count() > 0


def test_entry_has_rows(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
