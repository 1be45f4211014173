import pytest

from recordloom.plans import evidence_queries, file_queries, page_queries, record_queries, registry, registry_queries, stream_queries, text_queries  # noqa: F401
from tests.oracle import same


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    same(spark, "/root/testdata/sf0.001", registry.QUERIES[name], registry.ORACLE_SQL[name])


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(registry.ORACLE_SQL)
