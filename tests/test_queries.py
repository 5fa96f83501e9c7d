import pytest

from tessera.catalogue import COVERS, ORACLE, QUERIES
from tests.oracle import compare, connection


@pytest.fixture(scope="module")
def con(sf_dir):
    return connection(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, con, name):
    df = QUERIES[name](spark, sf_dir)
    if name in ORACLE:
        assert compare(df, con, ORACLE[name]) is None
    else:
        assert df.collect()
    assert COVERS[name]
