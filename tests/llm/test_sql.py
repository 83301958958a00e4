import pytest

from quadrille.llm.registry import collect
from tests.oracle import differences

QUERIES, SQL = collect()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_gives_the_rows_of_its_sql(spark, sf_dir, name):
    assert differences(spark, QUERIES[name], SQL[name], sf_dir.replace("sf0.001", "sf0.01")) is None


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
