import pytest

import __spark_entry__ as entry
from boxframe.plans import registry

from .oracle import difference

@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_against_sql(spark, sf_dir, name):
    assert difference(spark, sf_dir, entry.queries()[name], entry.oracle_sql()[name]) is None


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(registry.ORACLE_SQL)


def test_flagship(spark):
    row = entry.entry(spark).first()
    assert row.gold_total > 0 and 0 < row.f1 < 1
