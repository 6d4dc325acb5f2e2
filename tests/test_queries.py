"""Every registered query against its SQL, and the contract of the entry module."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from tests.conftest import SMALL
from tests.oracle import connection, differences
from tidewell.plans import registry


@pytest.fixture(scope="module")
def con():
    return connection(SMALL)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, con, name):
    assert differences(spark, con, SMALL, registry.queries()[name], registry.oracle_sql()[name]) == []


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_without_sql_has_rows(spark, name):
    assert registry.queries()[name](spark, SMALL).count() > 0


def test_entry_gives_one_report(spark):
    assert entry.entry(spark).count() == 1


def test_sql_has_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_else_imports_the_training_data_operators():
    from pathlib import Path

    root = Path(entry.__file__).parent
    for p in [*root.glob("tidewell/**/*.py"), root / "bench.py"]:
        if "llm" not in p.parts:
            assert "tidewell.llm" not in p.read_text() and "from .llm" not in p.read_text(), p
