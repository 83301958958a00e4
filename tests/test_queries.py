import pytest

from quadrille import registry
from tests.oracle import differences


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_gives_the_rows_of_its_sql(spark, sf_dir, name):
    if name in registry.SQL:
        assert differences(spark, registry.QUERIES[name], registry.SQL[name], sf_dir) is None
    else:
        assert registry.QUERIES[name](spark, sf_dir).schema == registry.QUERIES[name](spark, sf_dir).schema
