"""Every registered query beside its DuckDB oracle, on the smallest test tables."""

from pathlib import Path

import pytest

import __spark_entry__ as entry
import compare
from veridelta.plans import catalogue, surface  # noqa: F401

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
QUERIES, ORACLES = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return compare.connection(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    rows = df.collect()
    if name in ORACLES:
        columns, want = compare.oracle(con, ORACLES[name])
        assert sorted(columns) == sorted(df.columns)
        assert compare.bag(df.columns, rows) == compare.bag(columns, want)
    else:
        assert len(rows) <= 10


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns[0] == "op" and df.count() > 0


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_without_the_optional_parts(monkeypatch):
    """Without the optional subpackage the other queries are still there."""
    monkeypatch.setattr(entry, "llm", None)
    assert set(entry.queries()) == set(QUERIES) and set(entry.oracle_sql()) == set(ORACLES)
