"""Every registered query of the library against its SQL, on whole tables."""

import pytest

from tracelet.plans import catalog, ends  # noqa: F401


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLES)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_sql(agrees, name):
    agrees(catalog.QUERIES[name], catalog.ORACLES[name])


def test_entry(spark):
    import __spark_entry__ as e

    made = e.entry(spark)
    assert made.columns == ["seed", "prefix", "rank", "token", "probability"] and made.count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
