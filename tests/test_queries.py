import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.oracle_check import compare, connect

SF = "/root/testdata/sf0.001"
SQL = {name: sql for name, sql in oracle_sql().items() if not name.startswith("op")}
LLM = {name for name in queries() if name.startswith("op") or name == "pipeline"}  # tested in tests/llm


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, con, name):
    assert compare(queries()[name](spark, SF), con, SQL[name]) == ""


@pytest.mark.parametrize("name", sorted(set(queries()) - set(SQL) - LLM))
def test_query_without_sql_runs(spark, name):
    out = queries()[name](spark, SF).collect()
    assert out
    if name in ("studio_scoreboard", "studio_overrides"):
        assert all(r["status"] == "Ready" and 0.0 <= r["auc"] <= 1.0 for r in out)


def test_entry(spark):
    assert len(entry(spark).columns) == 8
