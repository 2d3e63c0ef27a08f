"""Every query with SQL against the SQL engine, on the smallest tables."""

import os

import pytest

import __spark_entry__ as project

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the tables aren't here")
CORE = [n for m in project._MODULES if ".llm" not in m.__name__ for n in m.QUERIES]


@pytest.fixture(scope="module")
def sql():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in os.listdir(FOLDER):
        con.execute(f"create view {f.split('.')[0]} as select * from '{FOLDER}/{f}'")
    return con


def plain(value):
    return f"{value:.6g}" if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", CORE)
def test_query(spark, sql, name):
    df = project.queries()[name](spark, FOLDER)
    got = sorted(tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect())
    assert got
    if (text := project.oracle_sql().get(name)) is not None:
        answer = sql.execute(text)
        names = [d[0] for d in answer.description]
        assert sorted(names) == sorted(df.columns)
        want = sorted(tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in answer.fetchall())
        assert got == want


@pytest.mark.parametrize("name", ["p1_found", "p5_found", "p5_entries", "p5_rules", "p5_delays", "priority_parse", "robots_wildcard_kind"])
def test_python_runs_once(spark, name):
    plan = project.queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_entry(spark):
    assert project.entry(spark).count() > 0
