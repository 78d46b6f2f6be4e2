"""Registered queries against their DuckDB statements."""

import pytest
from compare import compare, duck

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
ORACLE = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


def test_every_statement_has_a_query():
    assert set(ORACLE) <= set(entry.queries())
    unsaid = set(entry.queries()) - set(ORACLE)
    # operators of the pipeline are tested against brute force in tests/llm, scores of fitted trees in test_boosting
    assert all(k == "pipeline" or k.startswith("op") or k.endswith("_trees") for k in unsaid)


@pytest.mark.parametrize("key", sorted(ORACLE))
def test_query(spark, con, key):
    got = entry.queries()[key](spark, FOLDER).toArrow()
    assert compare(got, con.execute(ORACLE[key]).to_arrow_table()) == "ok"


def test_entry(spark):
    df = entry.entry(spark)
    assert "label" in df.columns and df.count() > 0
