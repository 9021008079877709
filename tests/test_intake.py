"""Validation, normalisation, enrichment maths and scoring on golden cases."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from sentrymill import schemas as S
from sentrymill.functions import network, scoring, text
from sentrymill.operators import intake
from sentrymill.sources import seed


def values(spark, expression, inputs, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, v {kind}")
    return [r.x for r in df.select("i", expression(F.col("v")).alias("x")).orderBy("i").collect()]


def test_ipv4(spark):
    good = ["192.168.1.1", " 10.0.0.1 ", "0.0.0.0", "255.255.255.255", "\t8.8.8.8\n"]
    bad = ["not-an-ip", "192.168.1", "", "2001:db8::1", "malicious.example.com", "10.0.0.01", "256.1.1.1",
           "1.1.1.1.1", "1.1.1.1\n2"]
    assert values(spark, network.is_ipv4, good) == [True] * len(good)
    assert values(spark, network.is_ipv4, bad) == [False] * len(bad)


def test_severity_and_status(spark):
    assert values(spark, intake.normal_severity, ["low", "HIGH", " critical\t", "EXTREME", "5", None]) == [
        "Low", "High", "Critical", None, None, None]
    assert values(spark, intake.normal_status, ["investigating", "CLOSED", "OPEN "]) == [
        "Investigating", None, "Open"]


def test_reject_reasons(spark):
    at = datetime(2024, 1, 1)
    rows = [
        (1, "Port Scan", "10.0.0.1", None, None, None, at),
        (2, None, None, None, None, None, at),
        (3, "X", "1.1.1.1", "5", "closed", "y" * 501, at),
        (4, "ok", "1.1.1.1", "low", "open", "y" * 500, at),
        (5, "z" * 101, "1.1.1.1", None, None, None, at),
    ]
    checked = intake.validate(spark.createDataFrame(rows, S.RAW_ALERTS))
    by_id = {r.id: r for r in checked.collect()}
    assert by_id[1].reasons == [] and by_id[1].severity == "Medium" and by_id[1].status == "Open"
    assert by_id[2].reasons == ["alert_type: required", "source_ip: required"]
    assert len(by_id[3].reasons) == 4 and by_id[3].severity == "5"
    assert (by_id[4].severity, by_id[4].status) == ("Low", "Open")
    assert len(by_id[5].reasons) == 1
    assert intake.accepted(checked).count() + intake.rejected(checked).count() == 5


def test_page_bounds():
    assert intake.check_range("limit", 100, 1, 100) == 100
    for bad in (0, 101, -1, True, 1.5):
        with pytest.raises(ValueError):
            intake.check_range("limit", bad, 1, 100)
    with pytest.raises(ValueError):
        intake.check_range("skip", -1, 0)


def test_levels(spark):
    scores = [15.0, 25.0, 26.0, 40.0, 60.0, 75.0, 76.0, 90.0, 25.5, 50.6, 75.01, -1.0, 100.5]
    assert values(spark, scoring.risk_level, scores, "double") == [
        "Low", "Low", "Medium", "Medium", "High", "High", "Critical", "Critical",
        "Critical", "Critical", "Critical", "Critical", "Critical"]
    closed = values(spark, lambda c: scoring.risk_level(c, "contiguous"), scores, "double")
    assert closed[8:11] == ["Medium", "High", "Critical"]
    with pytest.raises(ValueError):
        scoring.risk_level(F.lit(1), "other")


def test_scores(spark):
    cases = [
        ("Critical", "Ransomware", 100.0, True, 100.0),
        ("High", "Brute Force", 3.0, False, 50.6),
        ("High", "Brute Force", 82.0, False, 66.4),
        ("High", "Brute Force", 82.0, True, 76.4),
        ("Severe", "brute force", None, False, 35.0),
        ("Low", "Reconnaissance", 0.0, False, 18.0),
    ]
    df = spark.createDataFrame(cases, "severity string, kind string, conf double, night boolean, want double")
    got = df.select(scoring.risk_score(
        F.col("severity"), F.col("kind"), F.col("conf"), F.lit("2024-01-01 12:00:00").cast("timestamp"),
        F.col("night")).alias("s"), "want").collect()
    assert [r.s for r in got] == [r.want for r in got]


def test_off_hours_follow_utc(spark):
    times = ["2024-01-01 00:00:00", "2024-01-01 05:59:59", "2024-01-01 06:00:00", "2024-01-01 23:59:59"]
    old = spark.conf.get("spark.sql.session.timeZone")
    df = spark.createDataFrame([(t,) for t in times], "t string").select(F.col("t").cast("timestamp").alias("t"))
    micros = [r.m for r in df.select(F.unix_micros("t").alias("m")).collect()]
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
        fixed = spark.createDataFrame([(m,) for m in micros], "m long").select(F.timestamp_micros("m").alias("t"))
        got = [r.p for r in fixed.select(scoring.off_hours_points(F.col("t")).alias("p")).collect()]
        iso = [r.p for r in fixed.select(text.iso_utc(F.col("t")).alias("p")).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert got == [10.0, 10.0, 0.0, 0.0]
    assert iso[1] == "2024-01-01T05:59:59+00:00"


def test_confidence_and_verdict(spark):
    cases = [(65, 15, 90, 45.67, "Suspicious"), (100, 45, 90, 80.0, "Malicious"), (20, 2, 90, 12.89, "Clean"),
             (None, None, None, 0.0, "Clean"), (0, 5, 0, 200.0, "Malicious")]
    df = spark.createDataFrame(cases, "a long, m long, e long, want double, verdict string")
    conf = scoring.threat_confidence(F.col("a"), F.col("m"), F.col("e"))
    for r in df.select("*", conf.alias("c"), scoring.threat_verdict(conf).alias("v")).collect():
        assert (r.c, r.v) == (r.want, r.verdict)
    assert values(spark, scoring.threat_verdict, [None, 25.0, 24.99, 60.0], "double") == [
        "Unknown", "Suspicious", "Clean", "Malicious"]


def test_seed(spark):
    samples = seed.sample_alerts(spark, datetime(2024, 1, 10, 12))
    rows = samples.orderBy("id").collect()
    assert [r.risk_score for r in rows] == [80, 62, 48, 26, 66, 80, 42, 68, 22, 29]
    assert {r.threat_verdict for r in rows} == {"Unknown"}
    assert seed.seed_if_empty(samples.limit(0), samples).count() == 10
    assert seed.seed_if_empty(samples.where("id < 4"), samples).count() == 3


def test_like_patterns(spark):
    rows = spark.createDataFrame([("50% off",), ("50 off",), ("a_b",), ("axb",), ("c\\d",)], "v string")

    def hits(part, escape):
        return sorted(r.v for r in rows.where(F.col("v").ilike(text.contains_pattern(part, escape))).collect())

    assert hits("50%off", False) == ["50 off", "50% off"]
    assert hits("0% O", True) == ["50% off"]
    assert hits("A_B", False) == ["a_b", "axb"]
    assert hits("A_B", True) == ["a_b"]
    assert hits("C\\D", False) == ["c\\d"]


def test_ids_are_required_and_unique(spark):
    from sentrymill.plans.ingest import ingest
    from sentrymill.sources import sample_views as V

    at = datetime(2024, 1, 1)
    rows = [(1, "DDoS", "1.1.1.1", None, None, None, at), (1, "DDoS", "1.1.1.1", None, None, None, at),
            (None, "DDoS", "1.1.1.1", None, None, None, at), (2, "DDoS", "1.1.1.1", None, None, "b", at),
            (2, "DDoS", "1.1.1.1", None, None, "a", at), (3, "DDoS", "1.1.1.1", None, None, None, at)]
    raw = spark.createDataFrame(rows, S.RAW_ALERTS)
    stored = spark.createDataFrame([(3,)], "id long")
    done = ingest(raw, *V.feeds(spark, "/root/testdata/sf0.001"), existing=stored)
    assert sorted((r.id, r.description) for r in done.alerts.collect()) == [(1, None), (2, "a")]
    assert sorted((r.id or 0, r.reasons[0]) for r in done.rejects.collect()) == [
        (0, "id: required"), (1, "id: already used"), (2, "id: already used"), (3, "id: already used")]
    assert done.events.count() == 6


def test_a_repeated_feed_row_does_not_double_alerts(spark):
    from sentrymill.operators import enrich
    from sentrymill.plans.ingest import feeds_as_of
    from sentrymill.sources import sample_views as V

    folder = "/root/testdata/sf0.001"
    alerts, feeds = V.plain_alerts(spark, folder), V.feeds(spark, folder)
    once = enrich.enrich(alerts, *feeds)
    twice = enrich.enrich(alerts, *V.repeated_feeds(spark, folder))
    columns = ["id", "aggregate_confidence", "enrichment_data"]
    assert sorted(once.select(*columns).collect()) == sorted(twice.select(*columns).collect())
    abuse, scan, geo = feeds
    old, _, _ = feeds_as_of(*feeds, as_of=F.lit("2023-12-31").cast("timestamp") + F.expr("INTERVAL 90 DAYS"))
    assert 0 < old.count() < abuse.count()
    first, _, _ = feeds_as_of(abuse.limit(2), scan, geo, fallback=feeds)
    assert first.count() == abuse.count() and first.where("source = 'live'").count() == 2


def test_small_feeds_are_broadcast_and_large_ones_are_not(spark):
    import re

    from sentrymill.operators import skew

    def joins(limit):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", limit)
        try:
            df = skew.lookup_join(spark.range(1000), spark.range(50).selectExpr("id", "id AS x"), ["id"])
            df.collect()
            return re.findall("BroadcastHashJoin|SortMergeJoin", df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0])
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
            spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")

    assert joins("10MB") == ["BroadcastHashJoin"] and joins("-1") == ["SortMergeJoin"]


def test_a_light_history_is_a_plain_window(spark):
    from sentrymill.operators import alerts
    from sentrymill.sources import sample_views as V
    from sentrymill.session import cut_lineage

    folder = "/root/testdata/sf0.001"
    stored, changes = cut_lineage(V.light_alerts(spark, folder)), cut_lineage(V.status_changes(spark, folder))
    plan = alerts.change_status(stored, changes).history._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") <= 3 and plan.count("Exchange hashpartitioning") <= 4
