"""Every query of the library against its SQL on DuckDB, at the smallest scale."""

from __future__ import annotations

import duckdb
import pandas as pd
import pytest

from tidemark import plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SLOW = {"logistic_over_expectation", "calibrated_availability", "boosted_points_model", "gaussian_copula_slate"}


@pytest.fixture(scope="module")
def oracle(data):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{data}/{t}.parquet')")
    return con


def plain(df: pd.DataFrame) -> list[tuple]:
    def value(x):
        if x is None or x is pd.NaT or x is pd.NA or isinstance(x, float) and x != x:
            return None
        if isinstance(x, bool) or type(x).__name__ == "bool_":
            return bool(x)
        if hasattr(x, "tolist") and not hasattr(x, "isoformat"):
            x = x.tolist()
        if isinstance(x, (int, float)):
            return round(float(x), 9)
        return str(x)

    rows = [tuple(value(x) for x in r) for r in df[sorted(df.columns)].itertuples(index=False)]
    return sorted(rows, key=str)


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_query_equals_its_sql(spark, data, oracle, name):
    got, want = plans.queries()[name](spark, data).toPandas(), oracle.execute(plans.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


@pytest.mark.parametrize("name", sorted({*plans.queries()} - {*plans.oracle_sql()} - SLOW))
def test_query_without_sql_has_rows(spark, data, name):
    assert plans.queries()[name](spark, data).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 5
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
