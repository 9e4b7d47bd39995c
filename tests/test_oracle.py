from functools import lru_cache

import pytest
from oracle import compare

from stagewise import catalog


@pytest.fixture(scope="module", autouse=True)
def one_model():
    """All queries of this module share one model: its tables are stored once."""
    kept, catalog.model_of = catalog.model_of, lru_cache(catalog.model_of)
    yield
    catalog.model_of = kept


@pytest.mark.parametrize("name", list(catalog.ORACLE_SQL))
def test_matches_sql(spark, sf, name):
    compare(catalog.QUERIES[name](spark, sf), sf, catalog.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_the_rest_has_rows(spark, sf, name):
    assert catalog.QUERIES[name](spark, sf).count() > 0
