"""Deep pages, rewriting by day, and dashboards from partials."""

import os
import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from sentrymill import schemas as S
from sentrymill.operators import alerts, dashboard, rollup
from sentrymill.sources import sample_views as V, tables

FOLDER = "/root/testdata/sf0.001"
T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)


@pytest.fixture(scope="module")
def crowded(spark):
    """A third of the rows at one moment, some without a time."""
    rng = random.Random(3)
    rows = [(i, "High", T0 if i % 3 == 0 else None if i % 17 == 0 else T0 + timedelta(seconds=rng.randint(-500_000, 500_000)))
            for i in range(1200)]
    return spark.createDataFrame(rows, "id long, severity string, created_at timestamp").cache()


@pytest.mark.parametrize("skip", [0, 399, 700, 1090, 1190, 5000])
def test_a_deep_page_is_the_page(crowded, monkeypatch, skip):
    monkeypatch.setattr(alerts, "PAGE_ROWS", 50)
    monkeypatch.setattr(alerts, "PAGE_BINS", 8)
    got = [r.id for r in alerts.deep_page(crowded, skip, 40).collect()]
    assert got == [r.id for r in alerts.page(crowded, skip, 40).collect()]


def test_days_that_are_not_touched_stay(spark, tmp_path):
    path = str(tmp_path / "days")
    tables.append(V.light_alerts(spark, FOLDER), path, day_of="created_at")
    files = lambda: {d: sorted(os.listdir(f"{path}/{d}")) for d in os.listdir(path) if d.startswith("day=")}
    before, rows = files(), spark.read.parquet(path)
    first, second = sorted(before)[:2]
    some = rows.where((F.col("day").cast("string") == first[4:]) & (F.col("id") % 2 == 0)).select("id").collect()
    everything = rows.where(F.col("day").cast("string") == second[4:]).select("id").collect()
    gone = spark.createDataFrame([(r.id,) for r in some + everything + [some[0]]] + [(10**12,)], "id long")
    total = rows.count()
    assert tables.rewrite_days(spark, path, "id", gone) == [first[4:], second[4:]]
    after = files()
    assert {d for d in after if after[d] != before[d]} == {first} and second not in after
    assert spark.read.parquet(path).count() == total - len(some) - len(everything)
    assert tables.rewrite_days(spark, path, "id", spark.createDataFrame([(-1,)], "id long")) == [] and files() == after


def test_partials_add_up(spark):
    rows = V.alerts(spark, FOLDER).cache()
    none = spark.createDataFrame([], S.BLOCKED_IPS)
    parts = rollup.partials(rows.where("id % 3 = 0")).unionByName(rollup.partials(rows.where("id % 3 <> 0")))
    assert rollup.summary(rollup.merged(parts), none).collect() == dashboard.summary(rows, none).collect()
    exact = {r.threat_verdict: r["count"] for r in dashboard.by_verdict(rows, distinct_ips=True).collect()}
    for r in rollup.distinct_ips(parts).collect():
        assert abs(r["count"] - exact[r.threat_verdict]) <= max(1, 0.05 * exact[r.threat_verdict])
    moves = spark.createDataFrame([(1, "Open", "Resolved"), (1, "Resolved", "Open"), (2, "Investigating", "Resolved"), (10**12, "Open", "Resolved")],
                                  "id long, old_status string, new_status string")
    was = {r.status: r["count"] for r in dashboard.by_status(rows).collect()}
    now = rollup.summary(parts.unionByName(rollup.status_partials(rows, moves)), none).first()
    assert (now.open_alerts, now.investigating_alerts, now.resolved_alerts) == (was["Open"], was["Investigating"] - 1, was["Resolved"] + 1)
    assert now.total_alerts == sum(was.values())
    empty = rollup.summary(rollup.partials(rows.limit(0)), none).first()
    assert empty.total_alerts == 0 and empty.avg_risk_score == 0.0
