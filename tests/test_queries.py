"""Every registered query against its SQL, and those without SQL for their rows."""

import pytest

from foliate.jobs import registry
from tests.conftest import SMALL
from tests.oracle import compare

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_equal_to_sql(spark, name):
    compare(spark, SMALL, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_has_rows(spark, name):
    assert QUERIES[name](spark, SMALL).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
