"""Every registered analytic against its SQL on the smallest tables, and the driver's entry points."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from compare import connect, same  # noqa: E402

import __spark_entry__  # noqa: E402
from quillon import catalogue  # noqa: E402

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", catalogue.QUERIES)
def test_query(spark, con, name):
    if name in catalogue.SQL:
        assert same(spark, con, name, catalogue.QUERIES[name], catalogue.SQL[name], SF) is None
    else:
        assert catalogue.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_without_the_corpus_operators(monkeypatch):
    import importlib

    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    try:
        alone = importlib.reload(__spark_entry__)
        assert set(alone.queries()) == set(catalogue.QUERIES) and set(alone.oracle_sql()) == set(catalogue.SQL)
    finally:
        monkeypatch.undo()
        importlib.reload(__spark_entry__)
