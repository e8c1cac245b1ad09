"""Each query against its SQL in DuckDB."""

import math
import os

import duckdb
import pytest

from lodestone.plans import catalog


def rows(df):
    df = df[sorted(df.columns)]
    clean = lambda v: None if v is None or (isinstance(v, float) and math.isnan(v)) else round(float(v), 5) if isinstance(v, float) else v.item() if hasattr(v, "item") else v
    return sorted([tuple(map(clean, r)) for r in df.itertuples(index=False)], key=str)


@pytest.fixture(scope="session")
def duck(sf):
    con = duckdb.connect()
    for t in os.listdir(sf):
        con.sql(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{t}'")
    return con


@pytest.mark.parametrize("name", [n for n in catalog.QUERIES if n in catalog.SQL])
def test_query_gives_what_sql_gives(spark, sf, duck, name):
    got, expected = catalog.QUERIES[name](spark, sf).toPandas(), duck.sql(catalog.SQL[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    assert rows(got) == rows(expected)


@pytest.mark.parametrize("name", ["mine_l1_adaptive", "elo_ratings"])
def test_query_without_sql_gives_rows(spark, sf, name):
    assert catalog.QUERIES[name](spark, sf).count() > 0
