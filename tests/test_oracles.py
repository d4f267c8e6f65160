"""Every query with SQL gives DuckDB's rows."""

import os

import duckdb
import pytest

from quern.plans import registry

SF = os.environ.get("QUERN_TEST_DIR", "/root/testdata/sf0.001")
ORACLES = registry.oracle_sql()


def shown(v):
    if v is None or v != v:
        return "null"
    if hasattr(v, "tolist") and not isinstance(v, (int, float)):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(shown, v)) + "]"
    if isinstance(v, (int, float)) and not isinstance(v, bool):
        return repr(round(float(v), 9) + 0.0)
    return str(v)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"create view {f.removesuffix('.parquet')} as select * from read_parquet('{SF}/{f}')")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, con, name):
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted("|".join(shown(v) for v in r) for r in df.select(*columns).collect())
    rel = con.sql(f"select {', '.join(columns)} from ({ORACLES[name]})")
    assert got == sorted("|".join(shown(v) for v in r) for r in rel.fetchall())
