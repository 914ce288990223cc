"""Every registered query gives what its SQL gives, and none is registered without being run."""

import pytest
from helpers import SMALL, as_rows, duck

from millrace.plans import catalog


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, con, name):
    got = catalog.QUERIES[name](spark, SMALL).toPandas()
    if name not in catalog.ORACLES:
        assert len(got) > 0
        return
    assert as_rows(got) == as_rows(con.execute(catalog.ORACLES[name]).df())


def test_entry_is_complete(spark):
    import __spark_entry__ as entry

    assert set(catalog.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
