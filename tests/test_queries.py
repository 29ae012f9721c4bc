"""Every registered query of the engine against its SQL."""

import pytest

from support import DATA, same_rows
from tidemark.plans.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, duck, name):
    same_rows(QUERIES[name](spark, DATA), duck, ORACLE_SQL[name])


def test_all_queries_have_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
