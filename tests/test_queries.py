import pytest

from foretell.plans import domain_queries, market_queries, more_queries, stream_queries, survey_queries
from oracle import SF, connect, same

MODULES = [market_queries, domain_queries, more_queries, stream_queries, survey_queries]
WITH_SQL = [(n, m) for m in MODULES for n in m.SQL]
WITHOUT = [(n, m) for m in MODULES for n in m.QUERIES if n not in m.SQL]


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name,module", WITH_SQL, ids=[n for n, _ in WITH_SQL])
def test_like_sql(spark, con, name, module):
    same(spark, con, module.QUERIES[name], module.SQL[name], SF)


@pytest.mark.parametrize("name,module", [x for x in WITHOUT if x[0] != "forest_importance"], ids=[n for n, _ in WITHOUT if n != "forest_importance"])
def test_runs(spark, name, module):
    assert module.QUERIES[name](spark, SF).count() > 0


def test_registered_names_are_unique():
    names = [n for m in MODULES for n in m.QUERIES]
    assert len(names) == len(set(names))
