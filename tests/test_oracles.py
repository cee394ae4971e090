"""Each registered query of the library against its SQL, on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from docspark.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{SF}/*.parquet"):
        name = os.path.basename(path).split(".")[0]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return con


def plain(v):
    if v is None:
        return "~"
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    return str(v)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_equals_its_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(v) for v in r) for r in df.select(*columns).collect())
    sql = registry.oracle_sql()[name]
    rel = duck.sql(sql)
    assert sorted(rel.columns) == columns
    want = sorted(tuple(plain(v) for v in r) for r in duck.sql(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall())
    assert got == want
