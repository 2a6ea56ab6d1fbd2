"""Every registered query of the engine against the same in SQL."""

from __future__ import annotations

import pytest
from conftest import SF, oracle, rows_of

from quillflow.plans import queries as plans


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, name):
    got = plans.QUERIES[name](spark, SF).toPandas()
    if name not in plans.ORACLES:
        assert len(got) > 0
        return
    want = oracle(SF, plans.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


def test_no_dealt_name_is_registered_here():
    assert not [name for name in plans.QUERIES if name.startswith("op") and name[2:3].isdigit()]


def test_entry_imports_and_registers(spark):
    import __spark_entry__ as entry

    assert set(plans.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
