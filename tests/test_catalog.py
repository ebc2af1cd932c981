"""Every registered query with an oracle gives DuckDB's rows on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from lexiscope.plans import catalog

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def rows_of(df, columns):
    plain = lambda v: repr(round(v, 6) + 0.0) if isinstance(v, float) else repr(v.item() if hasattr(v, "item") else v)
    data = df[columns].astype(object).where(df[columns].notna(), None)
    return sorted("|".join(plain(x) for x in r) for r in data.values.tolist())


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_oracle(spark, duck, name):
    mine = catalog.queries()[name](spark, DATA).toPandas()
    want = duck.execute(catalog.oracle_sql()[name]).df()
    assert sorted(mine.columns) == sorted(want.columns)
    assert rows_of(mine, sorted(mine.columns)) == rows_of(want, sorted(want.columns))


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_other_queries_run(spark, name):
    assert catalog.queries()[name](spark, DATA).count() > 0


def test_entry(spark):
    assert {"lang", "precision", "recall", "f1"} <= set(entry.entry(spark).columns)
    assert set(entry.oracle_sql()) <= set(entry.queries())
