"""Ingest, listing, status, deletion, timeline, dashboard and playbooks on small sets."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sentrymill import schemas as S
from sentrymill.operators import actions, alerts, dashboard, enrich, intake, timeline
from sentrymill.plans.ingest import ingest

T0 = datetime(2024, 1, 1, 12)


@pytest.fixture(scope="module")
def feeds(spark):
    abuse = spark.createDataFrame([
        ("203.0.113.1", True, 90, "RU", "isp", None, 50, T0, False, "DC", "f"),
        ("10.0.0.2", False, 5, "US", "isp2", None, 1, T0 - timedelta(days=200), False, "C", "f"),
    ], S.TI_ABUSE)
    scan = spark.createDataFrame([
        ("203.0.113.1", 30, 1, 50, 9, 90, -5, "203.0.0.0/16", 1, "o", "RU", "RIPE", "x", ["c2"], "f"),
    ], S.TI_SCAN)
    geo = spark.createDataFrame([
        ("203.0.113.1", "h", "c", "r", None, "AS1 Org", "AS1", "tz", "0,0", "f"),
    ], S.TI_GEO)
    return abuse, scan, geo


@pytest.fixture(scope="module")
def stored(spark, feeds):
    rows = [
        (1, "Brute Force", "203.0.113.1", "High", None, "first", T0),
        (2, "Malware Detection", "10.0.0.2", "Critical", None, None, T0 + timedelta(minutes=1)),
        (3, "Port Scan", "192.168.1.3", "Low", None, None, T0 + timedelta(minutes=2)),
        (4, "Suspicious Login", "172.16.0.4", "Medium", "investigating", None, T0 + timedelta(minutes=3)),
        (5, "Credential Stuffing", "10.0.1.5", "High", None, None, T0 + timedelta(minutes=3)),
        (6, "Port Scan", "bad", None, None, None, T0),
    ]
    result = ingest(spark.createDataFrame(rows, S.RAW_ALERTS), *feeds)
    return result._replace(alerts=result.alerts.persist(), events=result.events.persist())


def test_ingest(stored):
    rows = {r.id: r for r in stored.alerts.collect()}
    assert len(rows) == 5 and stored.rejects.count() == 1
    one = rows[1]
    assert one.alert_id == "ALERT-00000001" and one.threat_verdict == "Malicious"
    assert one.risk_score == round(30 + 20 + (90 * 0.6 + 30 / 90 * 100 * 0.4) / 5, 2)
    report = json.loads(one.enrichment_data)
    assert report["country"] == "RU" and report["virustotal"]["tags"] == ["c2"]
    assert report["abuseipdb"]["domain"] is None and report["ipinfo"]["country"] is None
    assert rows[3].threat_verdict == "Unknown" and rows[3].enrichment_data is None
    assert rows[2].threat_verdict == "Clean"


def test_ingest_takes_the_large_table_path_too(spark, feeds, stored, all_heavy):
    raw = stored.alerts.select(*S.RAW_ALERTS.fieldNames())
    again = ingest(raw, *feeds).alerts.orderBy("id").collect()
    assert again == stored.alerts.orderBy("id").collect()


def test_three_events_in_order(stored):
    events = timeline.of_alert(stored.events, 1).collect()
    assert [e.event_type for e in events] == ["AlertCreated", "AlertEnriched", "RiskCalculated"]
    assert events[0].description == "Alert ingested | type=Brute Force ip=203.0.113.1 severity=High"
    assert events[1].description == "TI enrichment complete | verdict=Malicious confidence=67.3"
    assert json.loads(events[1].metadata_json) == {
        "threat_verdict": "Malicious", "aggregate_confidence": 67.33, "abuseipdb_score": 90, "vt_malicious": 30}
    assert events[2].description == "Risk score computed | score=63.47 level=High"
    assert timeline.of_alert(stored.events, 99).count() == 0
    assert timeline.of_alert_name(stored.events, "ALERT-00000002").count() == 3


def test_pages(stored):
    assert [r.id for r in alerts.page(stored.alerts, limit=3).collect()] == [5, 4, 3]
    assert [r.id for r in alerts.page(stored.alerts, skip=3, limit=3).collect()] == [2, 1]
    last = alerts.page(stored.alerts, limit=2).collect()[-1]
    nxt = alerts.page(stored.alerts, limit=2, after=(last.created_at, last.id))
    assert [r.id for r in nxt.collect()] == [3, 2]
    assert [r.id for r in alerts.page(stored.alerts, severity="High", alert_type="force").collect()] == [1]
    with pytest.raises(ValueError):
        alerts.page(stored.alerts, limit=101)
    empty = alerts.page_with_total(stored.alerts, status="Resolved").collect()
    assert len(empty) == 1 and (empty[0].total, empty[0].total_matching, empty[0].id) == (5, 0, None)


def changes(spark, rows):
    return spark.createDataFrame(rows, S.STATUS_CHANGES)


def test_status_changes(spark, stored):
    log = changes(spark, [
        (1, "investigating", T0 + timedelta(hours=1), 1), (1, "Resolved", T0 + timedelta(hours=2), 1),
        (1, "Resolved", T0 + timedelta(hours=2), 2), (2, "CLOSED", T0, 1), (77, "Open", T0, 1),
    ])
    result = alerts.change_status(stored.alerts, log)
    seen = [(r.old_status, r.new_status) for r in result.history.orderBy("ts", "seq").collect()]
    assert seen == [("Open", "Investigating"), ("Investigating", "Resolved"), ("Resolved", "Resolved")]
    one = result.alerts.where("id = 1").collect()[0]
    assert one.status == "Resolved" and one.updated_at == T0 + timedelta(hours=2)
    assert {(r.id, r.reason) for r in result.rejects.collect()} == {
        (2, "status: unknown"), (77, "alert not found")}
    assert result.alerts.count() == 5
    text = timeline.status_events(result.history).orderBy("occurred_at", "seq").first().description
    assert text == "Status changed: Open -> Investigating"


def test_delete_cascades(spark, stored):
    requests = spark.createDataFrame([(1, T0), (77, T0)], "id long, ts timestamp")
    runs = spark.createDataFrame([(1, "ALERT-00000001"), (2, "ALERT-00000002")], "alert_db_id long, alert_id string")
    result = alerts.delete(stored.alerts, stored.events, runs, requests)
    assert result.alerts.count() == 4
    assert result.timeline.where("alert_db_id = 1").count() == 0 and result.timeline.count() == 12
    assert [r.alert_db_id for r in result.executions.collect()] == [2]
    gone = result.deletions.collect()
    assert [(g.alert_db_id, g.event_type) for g in gone] == [(1, "AlertDeleted")]
    assert [r.id for r in result.rejects.collect()] == [77]


def test_merge_patch(spark, stored):
    patch = spark.createDataFrame(
        [(1, None, "low", None, None, T0 + timedelta(days=1)), (2, "X", None, None, None, T0)],
        "id long, alert_type string, severity string, status string, description string, ts timestamp")
    one, two = intake.merge_patch(stored.alerts, patch).where("id < 3").orderBy("id").collect()
    assert (one.severity, one.description, one.status) == ("Low", "first", "Open")
    assert one.updated_at == T0 + timedelta(days=1)
    assert two.alert_type == "Malware Detection"
    assert [r.id for r in intake.bad_patches(patch).collect()] == [2]


def test_nested_timeline(spark, stored):
    lonely = stored.events.where("alert_db_id <> 4")
    rows = {r.id: r for r in timeline.nested(stored.alerts, lonely).collect()}
    assert len(rows) == 5 and rows[4].events == [] and rows[4].chunk_no == 0
    assert [e.event_type for e in rows[1].events] == ["AlertCreated", "AlertEnriched", "RiskCalculated"]


def blocked(spark, rows=()):
    return spark.createDataFrame(list(rows), S.BLOCKED_IPS)


def test_dashboard(spark, stored):
    row = dashboard.summary(stored.alerts, blocked(spark, [("1.1.1.1", "A", "r", "b", None, T0)])).collect()[0]
    assert (row.total_alerts, row.open_alerts, row.investigating_alerts, row.resolved_alerts) == (5, 4, 1, 0)
    assert (row.critical_alerts, row.high_alerts, row.medium_alerts, row.low_alerts) == (1, 2, 1, 1)
    assert (row.malicious_ips, row.suspicious_ips, row.blocked_ips) == (1, 0, 1)
    buckets = dashboard.risk_distribution(stored.alerts).collect()
    assert [b.label for b in buckets] == ["Low", "Medium", "High", "Critical"]
    assert sum(b["count"] for b in buckets) == 5 and abs(sum(b.pct for b in buckets) - 100) < 0.3
    assert [r.id for r in dashboard.recent(stored.alerts, 2).collect()] == [5, 4]
    with pytest.raises(ValueError):
        dashboard.recent(stored.alerts, 51)
    days = dashboard.trend(stored.alerts, "2024-01-02", 3).orderBy("date").collect()
    assert [(r.date, r["count"]) for r in days] == [("2023-12-31", 0), ("2024-01-01", 5), ("2024-01-02", 0)]
    assert [(r.country, r["count"], r.total) for r in dashboard.by_country(stored.alerts).collect()] == [
        ("RU", 1, 2), ("US", 1, 2)]
    by = {r.status: r["count"] for r in dashboard.by_status(stored.alerts).collect()}
    assert by == {"Open": 4, "Investigating": 1, "Resolved": 0}


def test_dashboard_of_nothing(spark, stored):
    none = stored.alerts.limit(0)
    row = dashboard.summary(none, blocked(spark)).collect()[0]
    assert row.total_alerts == 0 and row.avg_risk_score == 0.0 and row.blocked_ips == 0
    assert [(b["count"], b.pct) for b in dashboard.risk_distribution(none).collect()] == [(0, 0.0)] * 4


def test_null_score_counts_as_low(spark, stored):
    none = stored.alerts.withColumn("risk_score", F.lit(None).cast("double"))
    assert dashboard.risk_distribution(none).collect()[0]["count"] == 5
    assert dashboard.mean_score(none).collect()[0][0] == 0.0


def requests(spark):
    rows = [
        ("ALERT-00000001", "block_ip", None, None, "ann", T0 + timedelta(hours=2), 1, None),
        ("ALERT-00000001", "block_ip", "", "because", None, T0 + timedelta(hours=1), 2, None),
        ("ALERT-00000002", "escalate", "db-1", None, "ann", T0, 3, None),
        ("ALERT-00000003", "notify_soc", None, None, "ann", T0, 4, None),
        ("ALERT-00000003", "isolate_host", "pc-1", None, "ann", T0, 5, "no route"),
        ("ALERT-00000003", "reboot", None, None, "ann", T0, 6, None),
        ("ALERT-MISSING", "reboot", None, None, "ann", T0, 7, None),
    ]
    return spark.createDataFrame(
        rows, "alert_id string, playbook_name string, target string, notes string, requested_by string, "
              "ts timestamp, seq long, error string")


def test_playbooks(spark, stored):
    found = actions.resolve(requests(spark), stored.alerts)
    assert {(r.seq, r.reason) for r in found.rejects.collect()} == {
        (6, "playbook not found"), (7, "alert not found")}
    runs = actions.executions(found.requests)
    rows = {r.seq: r for r in runs.collect()}
    assert (rows[2].target, rows[2].executed_by) == ("203.0.113.1", "system")
    first = json.loads(rows[1].result_data)
    assert rows[1].result_message == f"IP 203.0.113.1 successfully blocked. Rule ID: {first['rule_id']}"
    assert first["reason"] == "Automated block via SOAR playbook" and first["executed_at"] == "2024-01-01T14:00:00+00:00"
    assert len(first["actions_taken"]) == 3 and first["simulated"] is True
    up = json.loads(rows[3].result_data)
    assert up["priority"] == "P1" and len(up["actions_taken"]) == 5 and up["sla_deadline"] == up["executed_at"]
    assert (rows[5].status, rows[5].action, rows[5].result_message) == ("Failed", "ISOLATE_HOST", "")
    assert json.loads(rows[5].result_data) == {"error": "no route"}
    events = {e.seq: e for e in timeline.playbook_events(runs).collect()}
    assert json.loads(events[15].metadata_json)["action"] is None
    entries = actions.block_entries(runs, blocked(spark)).collect()
    assert [(e.ip_address, e.reason, e.blocked_at) for e in entries] == [
        ("203.0.113.1", "because", T0 + timedelta(hours=1))]
    known = blocked(spark, [("203.0.113.1", "A", "r", "b", None, T0)])
    assert actions.block_entries(runs, known).count() == 0
    assert [r.seq for r in actions.list_executions(runs, "ALERT-00000001").collect()] == [1, 2]
    with pytest.raises(ValueError):
        actions.list_executions(runs, limit=201)
    assert actions.catalog(spark).count() == 4


def test_candidates(stored):
    got = {(r.id, r.playbook_name) for r in actions.candidates(stored.alerts).collect()}
    assert {(1, "block_ip"), (1, "notify_soc")} <= got


def test_feed_helpers(spark, feeds):
    abuse = feeds[0]
    recent = enrich.recent_reports(abuse, F.lit(T0))
    assert [r.ip_address for r in recent.collect()] == ["203.0.113.1"]
    both = {r.ip_address: r.source for r in enrich.prefer(recent, abuse, "ip_address", "live", "stored").collect()}
    assert both == {"203.0.113.1": "live", "10.0.0.2": "stored"}
