"""Every query with SQL against DuckDB; the others against properties that hold for any right answer."""

import pytest

from lattica.plans import reference_queries

from .conftest import DATA, same_rows

SF = f"{DATA}/sf0.001"
QUERIES, SQL = reference_queries.queries(), reference_queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_twin(spark, duck, name):
    same_rows(QUERIES[name](spark, SF), duck(SF).sql(SQL[name]))


def test_every_query_without_sql_gives_rows(spark):
    for name in sorted(set(QUERIES) - set(SQL)):
        assert QUERIES[name](spark, SF).count() > 0, name


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(SQL) <= set(__spark_entry__.queries())
