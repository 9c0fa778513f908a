"""Every query of the library against its DuckDB oracle on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from tallyforge import catalog
from tallyforge.plans import registry  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(x):
    x = x.tolist() if hasattr(x, "tolist") else x
    if isinstance(x, list):
        return str(x)
    if pd.isna(x):
        return None
    return int(x) if isinstance(x, float) and x.is_integer() else x


def rows(df):
    df = df[sorted(df.columns)].astype(object)
    return sorted((tuple(map(plain, r)) for r in df.itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    got = catalog.QUERIES[name](spark, SF).toPandas()
    assert list(got.columns) == [c.lower() for c in got.columns]
    if name in catalog.ORACLES:
        want = con.execute(catalog.ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def test_entry(spark):
    import __spark_entry__

    assert os.path.isdir(SF) and __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
