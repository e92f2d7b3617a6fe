"""Every registered query of the reference's own operators against its SQL twin, or that it runs."""

import pytest

from quarrylight import plans

from . import oracle

ORACLE = plans.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return oracle.connection(sf)


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query(spark, sf, con, name):
    df = plans.queries()[name](spark, sf)
    if name in ORACLE:
        oracle.assert_same(con, df, ORACLE[name])
    else:
        rows = df.collect()
        assert rows and all(len(set(r.asDict())) == len(df.columns) for r in rows)


def test_names_are_unique_and_known():
    assert set(ORACLE) <= set(plans.queries())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
