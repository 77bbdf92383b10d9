import pytest

from sardabir.plans import catalog

from conftest import SMALL


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_matches_sql(name, same_as_sql):
    same_as_sql(catalog.QUERIES[name], catalog.ORACLE_SQL[name])


#: Those without SQL are held against plain loops in test_rules.py, test_books.py and test_made_up_books.py.
@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_query_runs(name, spark):
    assert catalog.QUERIES[name](spark, SMALL).count() > 0
