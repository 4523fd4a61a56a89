from pathlib import Path

import duckdb
import pytest

from codescope.llm import registered

SF_DIR = Path("/root/testdata/sf0.01")
pytestmark = pytest.mark.skipif(not SF_DIR.exists(), reason="given tables not at hand")


@pytest.mark.parametrize("name", sorted(registered.ORACLES))
def test_query_equals_oracle(spark, name):
    con = duckdb.connect()
    for table in SF_DIR.glob("*.parquet"):
        con.execute(f"CREATE VIEW {table.stem} AS SELECT * FROM '{table}'")
    result = con.execute(registered.ORACLES[name])
    columns = [c[0] for c in result.description]
    want = sorted(map(str, result.fetchall()))
    got = registered.QUERIES[name](spark, str(SF_DIR))
    assert sorted(got.columns) == sorted(columns)
    assert sorted(str(tuple(r)) for r in got.select(*columns).collect()) == want
