"""Every query that has SQL gives the same rows as that SQL; the others give a stable schema."""

import pytest
from conftest import SF

from skyloom.plans import registry

@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_same_as_sql(name, same):
    same(registry.QUERIES[name], registry.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_runs(name, spark):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_entry_without_llm(monkeypatch):
    import importlib
    import sys

    import __spark_entry__ as e

    try:
        monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
        left = importlib.reload(e)
        assert not [q for q in left.queries() if q.startswith("op") or q == "pipeline"]
        assert set(left.oracle_sql()) <= set(left.queries())
    finally:
        monkeypatch.undo()
        importlib.reload(e)
