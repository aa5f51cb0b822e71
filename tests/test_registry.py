import pytest
from compare import connect, same_rows

from pluvia.plans import registry


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_against_sql(spark, sf_dir, name):
    frame = registry.queries()[name](spark, sf_dir)
    same_rows(frame, connect(sf_dir), registry.oracle_sql()[name])


def test_only_these_have_no_sql():
    assert set(registry.queries()) - set(registry.oracle_sql()) == {"kriging", "forecast_shapley"}  # tested with their operators


def test_entry_imports(spark):
    import __spark_entry__ as entry

    assert set(registry.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["month", "spei", "level"]
