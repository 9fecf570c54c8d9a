from __future__ import annotations

import pytest

from sitelens import catalog
from tests.oracle import connect, mismatch

DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    return connect(DIR)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_equals_sql(spark, duck, name):
    df = catalog.queries()[name](spark, DIR)
    if name in catalog.oracle_sql():
        assert mismatch(df, duck, catalog.oracle_sql()[name]) is None
    else:
        assert df.count() >= 0


def test_every_query_has_sql():
    assert set(catalog.oracle_sql()) == set(catalog.queries())


def test_flagship(spark):
    assert catalog.flagship(spark, "/root/testdata/sf0.001").count() > 0
