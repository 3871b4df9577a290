"""Every query of the engine against its SQL in DuckDB; those without SQL must at least give rows."""

import pytest

from dapple.queries import QUERIES, SQL

from .compare import check, connect

#: Queries whose result can be empty on the smallest tables.
MAY_BE_EMPTY = {"stage_pretrain", "stage_open_dev", "stage_open_test"}


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    if name in SQL:
        check(df, con, SQL[name])
    else:
        assert df.count() > 0


def test_entry_points(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
