"""Every check beside DuckDB on the smallest tables."""

import pytest

from pixelspark.checks import QUERIES, SQL
from pixelspark.checks.compare import compare

TABLES = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(QUERIES))
def test_check(spark, name):
    outcome = compare(spark, TABLES, name)
    assert outcome.startswith("ok" if name in SQL else "rows only"), outcome


def test_entry_points(spark):
    import __spark_entry__ as contract

    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert contract.entry(spark).count() > 0
