"""Every registered query of the engine against its SQL on another engine."""

import duckdb
import pandas as pd
import pytest

from tidecount.plans import oracles, queries

QUERIES, SQL = queries.queries(), oracles.oracle_sql()
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def tidy(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]

    def value(x):
        if x is None or x is pd.NaT or (isinstance(x, float) and x != x):
            return None
        if isinstance(x, pd.Timestamp):
            return str(x)[:10]
        if isinstance(x, bool) or type(x).__name__ == "bool_":
            return bool(x)
        if isinstance(x, int | float) or type(x).__module__ == "numpy":
            return round(float(x), 6) + 0.0
        return str(x)[:10] if type(x).__name__ == "date" else x

    return sorted((tuple(map(value, row)) for row in df.itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, sf, duck, name):
    got, want = QUERIES[name](spark, sf).toPandas(), duck.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert tidy(got) == tidy(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_sql_only_for_registered():
    assert not set(SQL) - set(QUERIES)
