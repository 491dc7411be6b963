"""Every registered query against its SQL, also with every key cut into blocks."""

import pytest

import __spark_entry__ as entry
from catalog import check
from catalog.queries import REGISTRY

SMALL = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return check.connect(SMALL)


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_query(spark, con, name):
    build = entry.queries()[name]
    if name not in SQL:
        assert build(spark, SMALL).count() > 0
        return
    ok, note = check.compare(spark, con, SMALL, build, SQL[name])
    assert ok, note
    assert "types differ" not in note, note


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "cumulative_chars" in df.columns


def test_every_query_has_sql():
    assert set(REGISTRY) <= set(SQL)
