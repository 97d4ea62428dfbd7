"""Every registered query with SQL gives the same rows in DuckDB."""

import os

import duckdb
import pytest

from edgewright.plans import catalogue


def normal(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype.kind == "f":
            df[c] = df[c].map(lambda x: "" if x != x else f"{x:.3f}".replace("-0.000", "0.000"))
        else:
            # pandas shows a date as a date or as midnight, depending on the engine it comes from
            df[c] = df[c].map(lambda x: "" if x is None or x != x else str(x).removesuffix(" 00:00:00"))
    return sorted(map(tuple, df.itertuples(index=False)))


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{name}'")
    return con


#: Sums that end in a half of the last digit compared differ by rounding alone.
ROUNDED = {"drawdown", "gross_net"}


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_equals_sql(spark, duck, sf_dir, name):
    ours, theirs = catalogue.QUERIES[name](spark, sf_dir).toPandas(), duck.sql(catalogue.SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    if name in ROUNDED:
        keys = [c for c in ("segment", "trade_seq") if c in ours.columns]
        both = ours.merge(theirs, on=keys)
        assert len(both) == len(ours) == len(theirs)
        for c in set(ours.columns) - set(keys):
            assert (both[f"{c}_x"] - both[f"{c}_y"]).abs().max() < 2e-6
    else:
        assert normal(ours) == normal(theirs)


def test_queries_without_sql_have_rows(spark, sf_dir):
    for name in set(catalogue.QUERIES) - set(catalogue.SQL):
        assert catalogue.QUERIES[name](spark, sf_dir).count() > 0
