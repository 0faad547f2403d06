"""Every registered query against its SQL on the smallest tables."""

import os

import pytest

from annotary.plans import catalog
from tests.check_oracle import compare, connect
from tests.conftest import SF_DIR

QUERIES = catalog.load()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables absent")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, con, name):
    query = QUERIES[name]
    df = query.run(spark, SF_DIR)
    if query.sql is None:
        assert df.count() > 0
    else:
        assert compare(df, con, query.sql) is None


def test_entry_points(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert sorted(e.entry(spark).columns) == ["group_id", "image_id", "split"]
