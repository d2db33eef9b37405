"""Every query of the engine's own operators against its SQL twin at the smallest size."""

import pytest

from packetloom import catalog

from .conftest import DATA, duck, normal


@pytest.fixture(scope="module")
def sql():
    return duck("sf0.001")


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_matches_sql(spark, sql, name):
    got = normal(catalog.QUERIES[name](spark, f"{DATA}/sf0.001").toPandas())
    want = normal(sql.execute(catalog.ORACLES[name]).df())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, f"{DATA}/sf0.001").columns


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
