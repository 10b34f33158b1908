"""Every registered query against its SQL counterpart, whole results."""

import pytest
from compare import compare, connect

from tidymeter.catalog import load

ENTRIES = load()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", list(ENTRIES))
def test_query(spark, con, sf, name):
    entry = ENTRIES[name]
    note, _, good = compare(spark, con, sf, name, entry.run, entry.sql)
    assert good, note


def test_contract():
    import __spark_entry__ as driver

    assert set(driver.oracle_sql()) <= set(driver.queries())
    for prefix, count in {"s": 8, "f": 8, "x": 24, "c": 7, "w": 5, "j": 13, "b": 6, "e": 21, "g": 7, "m": 24, "r": 21, "t": 3}.items():
        ids = {q.split("_")[0] for q in driver.queries() if q.startswith(prefix)}
        assert {f"{prefix}{i:02d}" for i in range(1, count + 1)} <= ids


def test_entry(spark):
    import __spark_entry__ as driver

    assert driver.entry(spark).count() > 0
