"""Every registered query against its SQL on the smallest test set."""

import pytest

import __spark_entry__ as entry
from checks.compare import compare
from checks.registry import ORACLES, QUERIES
from tests.conftest import SF


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    if name in ORACLES:
        assert compare(spark, con, QUERIES[name], ORACLES[name], SF) == ""
    else:
        assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
