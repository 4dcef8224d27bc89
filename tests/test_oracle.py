"""Every core query with SQL gives DuckDB's rows on the smallest tables."""

import pytest

from strandlake.plans import registry
from tests.compare import rows, tables


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, small, name):
    made = registry.queries()[name](spark, small).toPandas()
    expected = tables(small).sql(registry.oracle_sql()[name]).df()
    columns = sorted(made.columns)
    assert columns == sorted(expected.columns)
    assert rows(made, columns) == rows(expected, columns)


def test_all_names_have_queries():
    assert set(registry.oracle_sql()) <= set(registry.queries())
