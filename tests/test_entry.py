"""The registry with and without the optional subpackage."""

import sys

import __spark_entry__
from pairforge.plans import catalog


def test_core_queries_stand_without_the_subpackage(monkeypatch):
    for gone in ("pairforge.llm", "corpus_pipeline", "zstandard"):
        with monkeypatch.context() as m:
            for name in [n for n in sys.modules if n == "corpus_pipeline" or n.startswith("pairforge.llm")]:
                m.delitem(sys.modules, name)
            m.setitem(sys.modules, gone, None)  # an import of it now raises ImportError
            assert __spark_entry__.queries() == catalog.QUERIES and __spark_entry__.oracle_sql() == catalog.ORACLES


def test_every_oracle_has_its_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
