from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from workload import queries as _queries

SF_DIR = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF_DIR.exists(), reason="given tables not at hand")


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(set(_queries.queries()) & set(entry.oracle_sql())))
def test_query_equals_oracle(spark, name):
    con = duckdb.connect()
    for table in SF_DIR.glob("*.parquet"):
        con.execute(f"CREATE VIEW {table.stem} AS SELECT * FROM '{table}'")
    result = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    want = sorted(map(str, result.fetchall()))
    got = entry.queries()[name](spark, str(SF_DIR)).select(*columns).collect()
    assert sorted(str(tuple(r)) for r in got) == want


def test_fixtures_trigger_the_rules(spark):
    run = lambda name: entry.queries()[name](spark, str(SF_DIR))
    assert 0 < run("apply_gitignore").count() < run("language_of").count()
    kinds = {(r["kind"], r["message"].split(":")[0]) for r in run("analysis_errors").collect()}
    assert len(kinds) == 4
    names = [r["name"] for r in run("npm_packages").unionByName(run("cargo_packages")).collect()]
    assert len(names) > len(set(names)) == run("last_wins_packages").count()
    dirs = {r["dir"] for r in run("code_directories").collect()}
    assert any(d.startswith(e + "/") for d in dirs for e in dirs)
