import pytest

from foretell.llm.oracle import ORACLE_SQL
from foretell.llm.queries import QUERIES
from oracle import SF, connect, same


@pytest.mark.parametrize("name", ORACLE_SQL)
def test_like_sql(spark, name):
    same(spark, connect(SF), QUERIES[name], ORACLE_SQL[name], SF)


def test_one_query_per_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
