import pytest

from shelfmark.oracle import SQL
from shelfmark.queries import QUERIES
from tests.oracle import compare, connection


@pytest.fixture(scope="module")
def con(sf_dir):
    return connection(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, con, name):
    df = QUERIES[name](spark, sf_dir)
    if name in SQL:
        compare(df, con, SQL[name])
    else:
        assert df.count() > 0


def test_every_oracle_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark, sf_dir):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_plans_push_columns(spark, sf_dir):
    text = QUERIES["human_sizes"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "text" not in text.split("ReadSchema")[1]
