"""Every query that has SQL, against it."""

import pytest

from millrace.plans import catalog

from .conftest import SMALL


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_its_sql(spark, duck, name):
    duck(catalog.QUERIES[name](spark, SMALL).toPandas(), catalog.SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_query_without_sql_runs(spark, name):
    rows = catalog.QUERIES[name](spark, SMALL).toPandas()
    assert len(rows) and len(rows.columns)
