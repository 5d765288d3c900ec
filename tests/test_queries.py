"""Every registered query against its SQL on the smallest tables."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as driver
from cahier.plans import table_queries, text_queries

SF = driver.SMALL
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(df: pd.DataFrame) -> pd.DataFrame:
    def show(v):
        if v is None or (pd.api.types.is_scalar(v) and pd.isna(v)):
            return None
        return repr(round(float(v), 6)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    df = df[sorted(df.columns)].astype(object).map(show)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def same(name, spark, db):
    ours, sql = driver.queries()[name](spark, SF).toPandas(), driver.oracle_sql()[name]
    theirs = db.execute(sql).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    pd.testing.assert_frame_equal(plain(ours), plain(theirs))


@pytest.mark.parametrize("name", [n for n in {**text_queries.ORACLES, **table_queries.ORACLES}])
def test_sql(name, spark, db):
    same(name, spark, db)


def test_entry(spark):
    assert driver.entry(spark).count() > 0


def test_every_query_is_registered_once():
    assert set(driver.oracle_sql()) <= set(driver.queries())
    assert not set(text_queries.QUERIES) & set(table_queries.QUERIES)
