"""Every query with SQL gives the rows that DuckDB gives, at the smallest scale."""

import math

import duckdb
import pandas as pd
import pytest

from cellframe.plans import catalogue, catalogue_checks, catalogue_files, catalogue_more, catalogue_tables  # noqa: F401  all register their queries with the first

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(df):
    out = []
    for r in df[sorted(df.columns)].itertuples(index=False):
        out.append(tuple(None if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and math.isnan(v) else round(float(v), 6) + 0.0 if isinstance(v, (int, float)) or hasattr(v, "dtype") or type(v).__name__ == "Decimal" else str(pd.Timestamp(v)) if type(v).__name__ in ("date", "datetime", "Timestamp") else str(v) for v in r))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query(spark, duck, name):
    a, b = catalogue.QUERIES[name](spark, SF).toPandas(), duck.execute(catalogue.SQL[name]).df()
    assert sorted(a.columns) == sorted(b.columns)
    assert rows(a) == rows(b)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0 and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
