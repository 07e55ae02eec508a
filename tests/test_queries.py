import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from fieldstream.plans import queries as plans

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(plans.SQL))
def test_query_equals_sql(spark, name):
    got = plans.queries()[name](spark, DATA).toPandas()
    con = duckdb.connect()
    con.sql(f"create view events as select * from '{DATA}/events.parquet'")
    want = con.sql(plans.SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda d: sorted(tuple("" if pd.isna(v) else repr(float(v)) if isinstance(v, float) else str(v) for v in r) for r in d[columns].astype(object).itertuples(index=False))
    assert rows(got) == rows(want)


def test_no_python_on_the_main_path(spark):
    for name in ("cell_windows", "alert_cooldown", "rising_trend", "alert_hot_region", "classify_asof_config"):
        plan = plans.queries()[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(plans.SQL) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
