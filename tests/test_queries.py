"""A sample of registered queries on the smallest tables against their SQL, and the contract."""

import pytest
from check import connect, rows_of_spark, rows_of_sql, same

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
SAMPLE = ("parse_place", "event_code", "reading_value", "calendar", "moments", "hourly_rollup", "access_incident", "pump_hourly", "asof_last_alarm", "burst_neighbours", "spread_neighbours",
          "target_stats_hourly", "pr_auc", "rolling_budget_7", "rolling_sum", "network_share", "water_event_features", "fire_level", "merge_cards", "create_orders", "dashboard_summary", "upsert_replace")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", SAMPLE)
def test_same_as_sql(spark, con, name):
    names, got = rows_of_spark(entry.queries()[name](spark, FOLDER))
    theirs, want = rows_of_sql(con, entry.oracle_sql()[name])
    assert names == theirs and got and same(got, want)


def test_contract(spark):
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 150
    assert entry.entry(spark).limit(1).count() == 1
