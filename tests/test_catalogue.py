import os

import pytest

from tessella.plans import catalogue, exchange, further  # noqa: F401
from tests import oracle

pytestmark = pytest.mark.skipif(not os.path.isdir(oracle.DATA), reason="the tables aren't here")


@pytest.fixture(scope="module")
def con():
    return oracle.connect()


def test_names():
    assert set(catalogue.ORACLES) <= set(catalogue.QUERIES)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_oracle(spark, con, name):
    oracle.same(spark, con, catalogue.QUERIES[name], catalogue.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_rows_only(spark, name):
    df = catalogue.QUERIES[name](spark, oracle.DATA)
    assert df.columns and df.count() >= 0


def test_greedy_query_equals_sequential(spark):
    rows = sorted((r.event_id, r.user_id, int(r.value * 100 // 1)) for r in spark.read.parquet(f"{oracle.DATA}/events.parquet").collect())
    a, b, want = set(), set(), set()
    for e, u, c in rows:
        if u not in a and c not in b:
            a.add(u)
            b.add(c)
            want.add(e)
    assert {r.event_id for r in catalogue.QUERIES["dedup_two_key_greedy"](spark, oracle.DATA).collect()} == want


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())
