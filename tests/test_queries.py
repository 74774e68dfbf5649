"""Every query of the reference's operators against its SQL, and those without SQL for their shape."""

import pytest

from oracle import assert_same

from tidemark.plans import all_queries, all_sql

QUERIES, SQL = all_queries(), all_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, small, name):
    assert_same(QUERIES[name](spark, small), SQL[name], small)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_has_rows(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0


def test_entry_imports_without_llm(monkeypatch):
    import sys

    import __spark_entry__ as entry

    monkeypatch.setitem(sys.modules, "tidemark.llm", None)
    assert set(entry.queries()) == set(QUERIES)
    assert set(entry.oracle_sql()) == set(SQL)
