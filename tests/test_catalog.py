"""Registered queries against their oracle SQL on the smallest sample."""

import pytest

import __spark_entry__ as entry
import oracle_check

FOLDER = "/root/testdata/sf0.001"
# One or two of each family; oracle_check.py runs all of them.
NAMES = [
    "s4_append_readback", "v7_accept_reject", "v8_merge_patch", "v9_key_clashes", "e4_prefer_source", "e16_report",
    "r6_risk_level", "a1_ingest_events", "a5_page_with_total", "a8_status_history", "t8_nested", "d6_summary",
    "d7_risk_distribution", "d9_trend", "p7_executions", "p9_block_register", "h12_resolve", "h15_continue",
    "h18_restore", "l2_usage", "w2_sliding_counts", "a6_stored_by_id", "t7_stored_of_alert_name",
]


@pytest.fixture(scope="module")
def con():
    return oracle_check.connect(FOLDER)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_oracle(spark, con, name):
    assert oracle_check.difference(spark, con, name, FOLDER) is None


@pytest.mark.parametrize("name", ["a1_ingest_alerts", "a10_delete_timeline", "t8_nested", "h16_replace", "h18_restore", "e5_as_of"])
def test_heavy_paths_equal_oracle(spark, con, name, all_heavy):
    assert oracle_check.difference(spark, con, name, FOLDER) is None


def test_every_query_has_an_oracle():
    from sentrymill.plans import catalog

    assert set(catalog.QUERIES) == set(catalog.ORACLES) and set(catalog.QUERIES) <= set(entry.queries())


def test_entry(spark):
    assert [r.label for r in entry.entry(spark).collect()] == ["Low", "Medium", "High", "Critical"]
