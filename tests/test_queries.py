"""Every query of the core engine against its SQL in another engine, on the smallest tables."""

import pytest
from compare import difference, engine

import __spark_entry__
from evloom import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def other():
    return engine(SF)


@pytest.mark.parametrize("name", catalog.ORACLES)
def test_same_rows(spark, other, name):
    assert difference(catalog.QUERIES[name](spark, SF), other, catalog.ORACLES[name]) is None


@pytest.mark.parametrize("name", [x for x in catalog.QUERIES if x not in catalog.ORACLES])
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).collect() is not None


def test_contract(spark):
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).columns


def test_common_tokens_match(spark):
    """A token that very many entities share finds the same candidates as comparing each query with each of them."""
    from evloom.operators import trust

    entities = [(f"e{i:03}", ("firm", "person")[i % 2]) for i in range(300)]
    aliases = [(e, "erp", "main", f"acme {i}" if i % 3 else "acme") for i, (e, _) in enumerate(entities)]
    queries = [("q1", "erp", "main", "acme", "person"), ("q2", "crm", "main", "acme works", "firm"), ("q3", "erp", "main", "acme 299", "firm"), ("q4", "erp", "main", "other", "firm")]
    want = []
    for q, source, _, text, kind in queries:
        found = []
        for (e, k), (_, s, _, t) in zip(entities, aliases):
            exact = (source, text) == (s, t)
            if exact or set(text.split()) & set(t.split()):
                found.append((-round((0.85 if exact else 0.25) + (0.1 if k == kind else 0), 6), e))
        want += [(q, e, -x, i) for i, (x, e) in enumerate(sorted(found)[:10], 1)]
    got = trust.match_identities(spark.createDataFrame(queries, "query_id string, source string, namespace string, normalized string, kind string"), spark.createDataFrame(entities, "id string, kind string"), spark.createDataFrame(aliases, "entity_id string, source string, namespace string, normalized string"))
    assert sorted(map(tuple, got.collect())) == sorted(want)
