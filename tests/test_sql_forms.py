"""Every query with a SQL form gives the rows the SQL gives."""

import pytest
from compare import database, difference, plan

from __spark_entry__ import entry, oracle_sql, queries

MADE, FORMS = queries(), oracle_sql()


@pytest.mark.parametrize("name", sorted(FORMS))
def test_same_as_sql(spark, small, name):
    df = MADE[name](spark, small)
    assert difference(df, database(small), FORMS[name]) is None
    text = plan(df)
    assert "CartesianProduct" not in text
    assert "NestedLoop" not in text


def test_every_form_has_a_query():
    assert set(FORMS) <= set(MADE)


def test_entry(spark):
    assert entry(spark).columns == ["source", "label", "examples", "avg_tokens"]
    assert entry(spark).count() > 0
