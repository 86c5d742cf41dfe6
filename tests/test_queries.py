"""Every engine query runs; those with SQL agree with it."""

from __future__ import annotations

import pytest

from palimpsest.plans import catalogue
from tests.conftest import DATA, rows

SQL = catalogue.oracle_sql()


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name):
    found = catalogue.queries()[name](spark, DATA).toPandas()
    assert len(found)
    if name in SQL:
        assert rows(found) == rows(duck.execute(SQL[name]).df())


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(SQL) <= set(entry.oracle_sql())
