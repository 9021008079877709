"""Reading and writing tables, and streams against the batch results."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sentrymill import schemas as S
from sentrymill.operators import actions, usage_log
from sentrymill.session import cut_lineage, run_dir
from sentrymill.sources import json_intake, tables
from sentrymill.sources import sample_views as V
from sentrymill.streaming import jobs

FOLDER = "/root/testdata/sf0.001"
T0 = datetime(2024, 1, 1)


def test_json_lines(spark, tmp_path):
    (tmp_path / "a.json").write_text(
        '{"id":1,"alert_type":"DDoS","source_ip":"1.1.1.1","created_at":"2024-01-01T00:00:00.5Z"}\n'
        '{"id":2,"alert_type":\n')
    rows = json_intake.read_raw(spark, str(tmp_path)).orderBy(F.desc_nulls_last("id")).collect()
    assert rows[0].alert_type == "DDoS" and rows[0].created_at == datetime(2024, 1, 1, 0, 0, 0, 500000)
    assert rows[0].severity is None and rows[0]._corrupt_record is None
    assert rows[1]._corrupt_record.startswith('{"id":2')


def test_missing_table_is_empty(spark, tmp_path):
    table = tables.open_or_empty(spark, str(tmp_path / "none"), S.TIMELINE)
    assert table.count() == 0 and table.schema == S.TIMELINE


def test_append_by_day(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([(i, T0 + timedelta(hours=i)) for i in range(48)], "id long, created_at timestamp")
    tables.append(rows, path, day_of="created_at")
    tables.append(rows, path, day_of="created_at")
    assert tables.scan(spark, path).where("day = date'2024-01-02'").count() == 48


def test_cut_lineage_keeps_rows(spark):
    df = spark.range(10).selectExpr("id", "array(id) AS a")
    cut = cut_lineage(df)
    assert cut.dtypes == df.dtypes and cut.count() == 10
    assert cut.where("id > 7").count() == 2


def test_stream_equals_batch(spark):
    raw = V.raw_alerts(spark, FOLDER)
    path, out, state = (run_dir(spark, n) for n in ("raw", "out", "state"))
    raw.unionAll(raw.where("id % 3 = 0")).repartition(6).write.parquet(path)
    stream = spark.readStream.schema(S.RAW_ALERTS).option("maxFilesPerTrigger", 2).parquet(path)
    jobs.intake(stream, lambda: V.feeds(spark, FOLDER), out, state).awaitTermination()
    got = jobs.read_batches(spark, f"{out}/alerts", S.ALERTS)
    from sentrymill.plans.ingest import ingest
    want = ingest(raw.unionAll(raw.where("id % 3 = 0")), *V.feeds(spark, FOLDER))
    assert got.select("batch").distinct().count() > 1
    columns = ["id", "risk_score", "threat_verdict", "enrichment_data"]
    assert sorted(got.select(*columns).collect()) == sorted(want.alerts.select(*columns).collect())
    assert jobs.read_batches(spark, f"{out}/events", S.TIMELINE).count() == want.events.count()
    assert jobs.read_batches(spark, f"{out}/rejects", S.RAW_ALERTS).count() == want.rejects.count()


def test_late_malformed_and_repeated_alerts_are_all_accounted_for(spark, tmp_path):
    path, out, state = str(tmp_path / "in"), run_dir(spark, "out"), run_dir(spark, "state")
    good = '{"id": %d, "alert_type": "Port Scan", "source_ip": "10.0.0.1", "created_at": "2024-01-%02dT00:00:00Z"}'

    def land(name, *lines):
        spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(f"{path}/{name}")
        stream = spark.readStream.schema(T.StructType([*S.RAW_ALERTS.fields, T.StructField("_corrupt_record", T.StringType())])).json(f"{path}/*")
        jobs.intake(stream, lambda: V.feeds(spark, FOLDER), out, state).awaitTermination()

    land("a", good % (1, 20), "{broken", "{also broken", "not json")
    land("b", good % (2, 2), good % (1, 21), good.replace('"id": %d, ', "") % 3, good % (4, 3), good % (4, 3))
    got = jobs.read_batches(spark, f"{out}/alerts", S.ALERTS).collect()
    assert sorted((r.id, r.created_at.day) for r in got) == [(1, 20), (2, 2), (4, 3)]      # 2 is 18 days late
    held = T.StructType([*S.RAW_ALERTS.fields, T.StructField("reasons", T.ArrayType(T.StringType()))])
    refused = jobs.read_batches(spark, f"{out}/rejects", held).collect()
    reasons = sorted(x for r in refused for x in r.reasons if x.startswith(("id: already", "body")))
    assert len(refused) == 6 and reasons == ["body: not valid JSON"] * 3 + ["id: already used"] * 2


def test_a_long_stream_leaves_no_scratch(spark):
    import os
    path, out, state = (run_dir(spark, n) for n in ("raw", "out", "state"))
    V.raw_alerts(spark, FOLDER).repartition(6).write.parquet(path)
    stream = spark.readStream.schema(S.RAW_ALERTS).option("maxFilesPerTrigger", 1).parquet(path)
    before = {n for n in os.listdir(os.path.dirname(path)) if n.startswith("cut-")}
    jobs.intake(stream, lambda: V.feeds(spark, FOLDER), out, state).awaitTermination()
    after = {n for n in os.listdir(os.path.dirname(path)) if n.startswith("cut-")}
    assert after == before


def test_late_rows_are_dropped(spark):
    path, out, state = (run_dir(spark, n) for n in ("late", "out", "state"))

    def land(*hours):
        rows = [(i, "High", 60.0, T0 + timedelta(hours=h)) for i, h in enumerate(hours)]
        spark.createDataFrame(rows, "id long, severity string, risk_score double, created_at timestamp").coalesce(
            1).write.mode("append").parquet(path)

    schema = "id long, severity string, risk_score double, created_at timestamp"

    def go():
        jobs.window_counts_job(spark.readStream.schema(schema).parquet(path), out, state).awaitTermination()

    land(0.1, 0.2, 5)
    go()
    land(0.3, 9)
    go()
    rows = jobs.read_window_counts(spark, out).orderBy("start").collect()
    assert [(r.start.hour, r["count"], r.risk_level) for r in rows] == [(0, 2, "High"), (5, 1, "High"), (9, 1, "High")]


def test_register_keeps_the_first_batch(spark):
    path, register, state = (run_dir(spark, n) for n in ("runs", "register", "state"))
    base = "alert_db_id long, alert_id string, seq long, playbook_name string, target string, status string, " \
           "executed_by string, executed_at timestamp, notes string"

    def land(*rows):
        spark.createDataFrame(
            [(1, a, i, "block_ip", ip, s, "x", T0 + timedelta(hours=h), None) for i, (a, ip, s, h) in enumerate(rows)],
            base).coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema(base).parquet(path)
        jobs.block_register(stream, register, state).awaitTermination()

    land(("A", "1.1.1.1", "Success", 5), ("B", "1.1.1.1", "Success", 4), ("C", "2.2.2.2", "Failed", 1))
    land(("D", "1.1.1.1", "Success", 1), ("E", "3.3.3.3", "Success", 9))
    rows = jobs.read_batches(spark, register, S.BLOCKED_IPS).orderBy("ip_address").collect()
    assert [(r.ip_address, r.alert_id, r.batch) for r in rows] == [("1.1.1.1", "B", 0), ("3.3.3.3", "E", 1)]
    assert actions.list_blocked(jobs.read_batches(spark, register, S.BLOCKED_IPS)).first().ip_address == "3.3.3.3"
    jobs.compact_register(spark, register, 1)
    land(("F", "1.1.1.1", "Success", 0), ("G", "4.4.4.4", "Success", 1))
    held = jobs.read_compacted(spark, register, S.BLOCKED_IPS).collect()
    assert sorted((r.ip_address, r.alert_id) for r in held) == [("1.1.1.1", "B"), ("3.3.3.3", "E"), ("4.4.4.4", "G")]


def test_status_stream_and_compaction(spark):
    path, table, state = (run_dir(spark, n) for n in ("chg", "status", "state"))
    V.status_changes(spark, FOLDER).repartition(5).write.parquet(path)
    stream = spark.readStream.schema(S.STATUS_CHANGES).option("maxFilesPerTrigger", 2).parquet(path)
    jobs.status_table(stream, table, state).awaitTermination()
    got = jobs.read_status(spark, table)
    before = sorted(got.collect())
    jobs.compact_status(spark, table, 1)
    assert sorted(jobs.read_status(spark, table).collect()) == before
    spark.createDataFrame([(1, "Open", datetime(2030, 1, 1), 1)], S.STATUS_CHANGES).write.mode("append").parquet(path)
    jobs.status_table(stream, table, state).awaitTermination()      # the stream goes on beside the snapshot
    jobs.compact_status(spark, table, 99)
    after = {r.id: r for r in jobs.read_status(spark, table).collect()}
    assert after[1].new_status == "Open" and after[1].ts == datetime(2030, 1, 1) and len(after) == len(before)
    assert got.count() == spark.read.parquet(path).where("lower(trim(new_status)) <> 'closed'").select("id").distinct().count()


def test_log_never_holds_text(spark):
    calls = V.model_calls(spark, FOLDER)
    log = usage_log.log_rows(calls)
    assert "text" in calls.columns and log.columns == S.USAGE_LOG.fieldNames()
    assert log.where("total_tokens <> prompt_tokens + completion_tokens").count() == 0
    bare = usage_log.log_rows(spark.createDataFrame([(1,)], "id long")).collect()[0]
    assert (bare.total_tokens, bare.success, bare.has_phi_warning, bare.latency_ms) == (0, True, False, 0.0)


def test_late_rows_are_counted_apart(spark, tmp_path):
    path, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    schema = "id long, severity string, risk_score double, created_at timestamp"

    def land(*hours):
        rows = [(i, "High", 60.0, T0 + timedelta(hours=h)) for i, h in enumerate(hours)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        jobs.window_counts_job(spark.readStream.schema(schema).parquet(path), out, state).awaitTermination()

    land(0.1, 0.2, 5)
    land(0.3, 0.4, 4.5, 9)
    jobs.compact_windows(spark, out, 0)
    land(0.6, 9.5)
    counted = {r.start.hour: r["count"] for r in jobs.read_window_counts(spark, out).collect()}
    late = {r.start.hour: r.late for r in jobs.read_late_counts(spark, out).collect()}
    assert counted == {0: 2, 4: 1, 5: 1, 9: 2} and late == {0: 3}


def _files_at_each_run(monkeypatch, job):
    """A list that gets the files of the newest landing folder at each start of the job."""
    import glob
    from sentrymill.plans import catalog
    seen, folders, real, real_dir = [], [], getattr(jobs, job), catalog.run_dir

    def run(*args, **options):
        seen.append(len(glob.glob(f"{folders[0]}/*.parquet")))
        return real(*args, **options)

    def run_dir_(session, name):
        folders.extend([path := real_dir(session, name)] if name in ("alerts", "runs") else [])
        return path if name in ("alerts", "runs") else real_dir(session, name)

    monkeypatch.setattr(jobs, job, run)
    monkeypatch.setattr(catalog, "run_dir", run_dir_)
    return seen


def _four_files_of_alerts(spark, monkeypatch):
    rows = spark.range(0, 300, 1, 4).selectExpr(
        "id", "'High' AS severity", "60.0D AS risk_score",
        "timestamp'2024-01-01 00:30:00' + make_interval(0, 0, 0, int(id % 30)) AS created_at")
    monkeypatch.setattr(V, "alerts", lambda *_: rows)


@pytest.mark.parametrize("name", ["w2_hourly_counts", "w2_sliding_counts"])
def test_a_week_of_alerts_is_a_batch_of_many_files(spark, monkeypatch, name):
    from sentrymill.plans import catalog
    _four_files_of_alerts(spark, monkeypatch)
    seen = _files_at_each_run(monkeypatch, "window_counts_job")
    counted = catalog.QUERIES[name](spark, "none")
    assert counted.agg(F.sum("count")).first()[0] == 300 * (2 if "sliding" in name else 1)
    assert seen == [4, 8, 12, 16, 20]      # a week is not written by one task


def test_late_weeks_are_batches_of_many_files(spark, monkeypatch):
    from sentrymill.plans import catalog
    _four_files_of_alerts(spark, monkeypatch)
    seen = _files_at_each_run(monkeypatch, "window_counts_job")
    counted = catalog.QUERIES["w2_late_counts"](spark, "none")
    assert counted.agg(F.sum("rows")).first()[0] == 300 and seen == [4, 8, 12, 16, 20]


def test_a_week_of_runs_is_a_batch_of_many_files(spark, monkeypatch):
    from sentrymill.plans import catalog
    rows = spark.range(0, 300, 1, 4).selectExpr(
        "id AS alert_db_id", "'A' || id AS alert_id", "id AS seq", "'block_ip' AS playbook_name", "'10.0.0.' || id % 60 AS target",
        "'Success' AS status", "'x' AS executed_by", "'' AS notes",
        "timestamp'2024-01-01 00:30:00' + make_interval(0, 0, 0, int(id % 30)) AS executed_at")
    monkeypatch.setattr(catalog, "_runs", lambda *_: rows)
    seen = _files_at_each_run(monkeypatch, "block_register")
    held = {r.ip_address: r.alert_id for r in catalog.QUERIES["w3_block_register"](spark, "none").collect()}
    assert held == {f"10.0.0.{i}": min(f"A{k}" for k in range(i, 300, 60)) for i in range(60)}
    assert seen == [4, 8, 12, 16, 20]
