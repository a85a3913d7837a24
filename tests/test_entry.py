import duckdb
import pandas as pd
import pytest

import __spark_entry__
from facetry import workload

SMALL = "/root/testdata/sf0.001"


def rounded(value):
    return None if value is None or pd.isna(value) else round(value, 3) if isinstance(value, float) else str(value).removesuffix(" 00:00:00")


@pytest.mark.parametrize("name", workload.ORACLES)
def test_workload_against_sql(spark, name):
    found = workload.QUERIES[name](spark, SMALL).toPandas()
    con = duckdb.connect()
    for t in workload.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    want = con.sql(workload.ORACLES[name]).df()
    assert sorted(found.columns) == sorted(want.columns)
    rows = lambda df: sorted((tuple(map(rounded, r)) for r in df[sorted(df.columns)].astype(object).itertuples(index=False)), key=str)
    assert rows(found) == rows(want)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 5
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert "approx_distinct" in __spark_entry__.queries()
