"""Every query against its SQL, on the smallest tables."""

import pytest

from helpers import plain
from tickframe.queries import ORACLES, QUERIES

duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def db(sf):
    c = duckdb.connect()
    for t in ("events", "lineitem", "orders", "part"):
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf, db, name):
    got, wanted = QUERIES[name](spark, sf).toPandas(), db.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(wanted.columns)
    assert plain(got) == plain(wanted)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_other_queries_run(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry_works_without_the_optional_subpackage(spark, monkeypatch):
    import __spark_entry__ as entry

    monkeypatch.setattr(entry, "_llm_present", lambda: False)
    assert set(entry.queries()) == set(QUERIES) and set(entry.oracle_sql()) == set(ORACLES)
    assert entry.entry(spark).count() > 0


def test_all_twenty_indicators_share_one_exchange_of_the_bars(spark, sf):
    from tickframe.queries import ALL
    from tickframe.sources.bars import bars_hourly

    plan = ALL.run_wide(bars_hourly(spark, sf).persist())._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") - plan.count("InMemory") <= 2
