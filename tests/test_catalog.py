"""Every registered query against its SQL on the smallest driver tables."""

import pytest

import __spark_entry__ as entry_module
from tests.oracle import compare, duck

PATH = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry_module.queries(), entry_module.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(PATH)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, name):
    assert compare(QUERIES[name](spark, PATH), con, ORACLES[name]) == []


def test_entry(spark):
    df = entry_module.entry(spark)
    counts = [r["count"] for r in df.groupBy("affiliation_id").count().collect()]
    assert counts and all(10 <= c <= 15 for c in counts)


def test_stream_equals_batch(spark):
    batch = {r["mention_id"]: r["predictions"] for r in QUERIES["resolve_affiliations"](spark, PATH).collect()}
    stream = {r["mention_id"]: r["predictions"] for r in QUERIES["stream_resolve"](spark, PATH).collect()}
    assert stream == batch
