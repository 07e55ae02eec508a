import duckdb
import pytest

import __spark_entry__ as entry
from fieldstream.llm import queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    got = queries.queries()[name](spark, DATA)
    con = duckdb.connect()
    for name_of in ("documents", "embeddings"):
        con.sql(f"create view {name_of} as select * from '{DATA}/{name_of}.parquet'")
    want = con.sql(queries.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert sorted(map(tuple, got.select(*columns).collect()), key=str) == sorted(want.select(*columns).fetchall(), key=str)


def test_all_are_registered():
    found = entry.queries()
    assert {f"op{n}" for n in range(1, 14)} <= {k.split("_")[0] for k in found} and "pipeline" in found
    assert set(queries.oracle_sql()) <= set(found)
