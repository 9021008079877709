"""Heavy keys: found exactly, cut without changing any result."""

import random

import pytest
from pyspark.sql import functions as F

from sentrymill.operators import alerts, skew, timeline, tokens


@pytest.fixture
def skewed(spark):
    rng = random.Random(5)
    rows = []
    for i in range(6000):
        key = 1 if i % 3 == 0 else rng.randrange(2, 900)
        rows.append((key if i % 50 else None, rng.randrange(0, 4000), i, rng.choice("abc")))
    return spark.createDataFrame(rows, "k long, at long, seq long, v string").repartition(7)


def test_heavy_keys_are_few_and_right(spark, skewed):
    found = {r.k: r._parts for r in skew.heavy_keys(skewed, ["k"], 0.05, 1).collect()}
    assert set(found) == {1}
    assert 5 <= found[1] <= 8
    assert skew.heavy_keys(skewed, ["k"]).count() == 0


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_lookup_join_equals_plain_join(spark, skewed, all_heavy, how):
    dim = spark.createDataFrame([(k, k * 10) for k in range(0, 600)], "k long, x long")
    mine = skew.lookup_join(skewed, dim, ["k"], how)
    plain = skewed.join(dim, ["k"], how)
    assert mine.columns == plain.columns
    assert sorted(map(str, mine.collect())) == sorted(map(str, plain.collect()))


def test_lookup_join_refuses_other_joins(skewed):
    with pytest.raises(ValueError):
        skew.lookup_join(skewed, skewed, ["k"], "full_outer")


def _by_key(skewed):
    groups = {}
    for r in skewed.collect():
        groups.setdefault(r.k, []).append((r.at, r.seq, r.v))
    return {k: sorted(v) for k, v in groups.items()}


def test_row_number_over_slices(spark, skewed, all_heavy):
    got = skew.sliced_row_number(skewed, ["k"], ["at", "seq"], "at", "n").collect()
    want = {
        (k, at, seq): i for k, rows in _by_key(skewed).items()
        for i, (at, seq, _) in enumerate(rows, 1)
    }
    assert {(r.k, r.at, r.seq): r.n for r in got} == want


def test_previous_over_slices(spark, skewed, all_heavy):
    got = skew.sliced_previous(skewed, ["k"], ["at", "seq"], "at", "v", "p").collect()
    want = {}
    for k, rows in _by_key(skewed).items():
        for before, (at, seq, _) in zip([None, *[r[2] for r in rows]], rows):
            want[(k, at, seq)] = before
    assert {(r.k, r.at, r.seq): r.p for r in got} == want


def test_slices_cut_the_heavy_key_evenly(spark, skewed, all_heavy):
    cut = skew._sliced(skewed, ["k"], "at", skew.heavy_keys(skewed, ["k"]))
    sizes = [r["count"] for r in cut.where("k = 1").groupBy("_slice").count().collect()]
    assert len(sizes) > 10
    assert max(sizes) < 6000 * 0.02 * 2


def test_many_parts_use_the_two_step_search(spark, monkeypatch):
    monkeypatch.setattr(skew, "HEAVY_SHARE", 0.002)
    monkeypatch.setattr(skew, "LEAST_ROWS", 1)
    rows = spark.range(20000).selectExpr("1L AS k", "(id * 7919) % 20011 AS at")
    got = skew.sliced_row_number(rows, ["k"], ["at"], "at", "n")
    wrong = got.join(
        rows.selectExpr("at", "row_number() over (order by at) as want"), "at"
    ).where("n <> want")
    assert wrong.count() == 0
    parts = skew._sliced(rows, ["k"], "at", skew.heavy_keys(rows, ["k"])).select("_slice").distinct().count()
    assert parts > 400


def test_nested_timeline_of_a_heavy_alert(spark, all_heavy):
    rows = [(i % 40 if i % 2 else 7, f"A{i % 40 if i % 2 else 7}", "StatusUpdated", i, f"d{i}", None, i % 97)
            for i in range(3000)]
    events = spark.createDataFrame(
        rows, "alert_db_id long, alert_id string, event_type string, seq long, description string, "
              "metadata_json string, t long"
    ).withColumn("occurred_at", F.timestamp_seconds("t")).drop("t")
    heads = spark.range(50).selectExpr(
        "id", "'A' || id AS alert_id", "'x' AS alert_type", "'1.1.1.1' AS source_ip", "'Low' AS severity",
        "'Open' AS status", "1D AS risk_score", "'Clean' AS threat_verdict",
        "timestamp_seconds(id) AS created_at",
    )
    got = {}
    for r in timeline.nested(heads, events, chunk=100).orderBy("id", "chunk_no").collect():
        assert len(r.events) <= 100
        got.setdefault(r.id, []).extend(e.description for e in r.events)
    want = {i: [] for i in range(50)}
    for key, _, _, seq, text, _, t in sorted(rows, key=lambda r: (r[6], r[3])):
        want[key].append(text)
    assert got == want


def test_status_history_of_a_heavy_alert(spark, all_heavy):
    heads = spark.range(20).selectExpr(
        "id", "'A' || id AS alert_id", "'Open' AS status", "timestamp_seconds(0) AS updated_at"
    )
    states = ["Open", "Investigating", "Resolved"]
    log = [(3 if i % 2 else i % 25, states[i * 7 % 3], i % 31, i) for i in range(1500)]
    changes = spark.createDataFrame(log, "id long, new_status string, t long, seq long").select(
        "id", "new_status", F.timestamp_seconds("t").alias("ts"), "seq"
    )
    result = alerts.change_status(heads, changes)
    state, want = {i: "Open" for i in range(20)}, {}
    for key, new, _, seq in sorted(log, key=lambda r: (r[2], r[3])):
        if key < 20:
            want[seq] = (key, state[key], new)
            state[key] = new
    assert {r.seq: (r.id, r.old_status, r.new_status) for r in result.history.collect()} == want
    assert {r.id: r.status for r in result.alerts.collect()} == state
    assert result.rejects.count() == sum(1 for r in log if r[0] >= 20)


def test_token_numbers_of_a_heavy_session(spark, all_heavy):
    rows = [("big" if i % 3 else f"s{i % 5}", i, 0, f"v{i % 700}@x.com", "EMAIL") for i in range(2000)]
    found = spark.createDataFrame(
        rows, "session_id string, text_seq long, start int, value string, entity_type string"
    )
    given = tokens.assign(found, F.lit("2024-01-01").cast("timestamp")).collect()
    want, used = {}, {}
    for session, _, _, value, _ in rows:
        if (session, value) not in want:
            used[session] = used.get(session, 0) + 1
            want[(session, value)] = f"EMAIL_{used[session]:03d}"
    assert {(r.session_id, r.value): r.token for r in given} == want


def test_only_events_of_heavy_alerts_are_sliced(spark, monkeypatch):
    """The events of all others go by alert once; those without an alert belong to none."""
    monkeypatch.setattr(skew, "LEAST_ROWS", 100)
    events = spark.range(0, 400, 1, 4).selectExpr(
        "if(id < 250, 1L, if(id = 399, NULL, id % 50)) AS alert_db_id", "'n' AS alert_id", "'k' AS event_type", "id AS seq", "'d' AS description",
        "'{}' AS metadata_json", "timestamp_seconds(1000 - id) AS occurred_at")
    heads = spark.range(0, 52).selectExpr(
        "id", "'n' AS alert_id", "'t' AS alert_type", "'i' AS source_ip", "'High' AS severity", "'Open' AS status", "1.0D AS risk_score",
        "'Clean' AS threat_verdict", "timestamp'2024-01-01' AS created_at")
    sliced, real = [], timeline.sliced_row_number

    def numbered(df, *args):
        sliced.append(sorted(r.alert_db_id for r in df.select("alert_db_id").distinct().collect()))
        return real(df, *args)

    monkeypatch.setattr(timeline, "sliced_row_number", numbered)
    want = {}
    for r in events.where("alert_db_id is not null").collect():
        want.setdefault(r.alert_db_id, []).append((r.occurred_at, r.seq))
    got = {}
    for r in timeline.nested(heads, events, chunk=100).orderBy("id", "chunk_no").collect():
        assert len(r.events) <= 100 and [e.position for e in r.events] == list(range(r.chunk_no * 100 + 1, r.chunk_no * 100 + 1 + len(r.events)))
        got.setdefault(r.id, []).extend((e.occurred_at, e.metadata_json) for e in r.events)
    assert {k: [(at, "{}") for at, _ in sorted(v)] for k, v in want.items()} == {k: v for k, v in got.items() if v}
    assert len(got) == 52 and sliced == [[1]]


def test_reports_of_the_nested_query_are_worked_out_once(spark, monkeypatch, tmp_path):
    from sentrymill.operators import enrich
    from sentrymill.plans import catalog
    from sentrymill.sources import sample_views
    calls, real = [], enrich.report_table

    def counted(*args):
        calls.append(1)
        return real(*args)

    monkeypatch.setattr(enrich, "report_table", counted)
    monkeypatch.setattr(sample_views, "report_table", counted, raising=False)
    spark.range(0, 200).selectExpr(
        "id AS event_id", "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, int(id)) AS ts", "id % 90 AS user_id",
        "'click' AS event_type", "double(id % 100) AS value", "'{}' AS props").write.parquet(f"{tmp_path}/events.parquet")
    nested = catalog.QUERIES["t8_nested"](spark, str(tmp_path))
    assert nested.select("id").distinct().count() == 200 and len(calls) == 1


def test_heavy_keys_are_counted_once(spark, skewed, all_heavy, monkeypatch):
    """What finds out whether there are any also says which: the rows are not counted again."""
    stored, real = [], skew.cut_lineage
    monkeypatch.setattr(skew, "cut_lineage", lambda df: stored.append(df.columns) or real(df))
    counted, count = [], skew.heavy_keys
    monkeypatch.setattr(skew, "heavy_keys", lambda *a: counted.append(1) or count(*a))
    rows = skew.sliced_row_number(skewed, ["k"], ["at", "seq"], "at", "n")
    assert rows.count() == skewed.count() and counted == [1] and [c[-1] for c in stored] == ["_parts"]
