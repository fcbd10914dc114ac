"""Every registered query against its SQL, over the whole smallest test tables."""

import pytest

from __spark_entry__ import entry
from portfold.catalog.oracles import ORACLES
from portfold.catalog.queries import QUERIES
from tests.compare import differences
from tests.conftest import SMALL


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_agrees_with_sql(spark, con, name):
    problem, rows = differences(spark, con, name, SMALL)
    assert not problem
    assert rows > 0


def test_every_query_has_sql():
    assert set(ORACLES) == set(QUERIES)


def test_entry_has_rows(spark):
    assert entry(spark).count() > 0
