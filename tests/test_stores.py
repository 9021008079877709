"""The id store of the intake and the token store."""

import pytest
from pyspark.sql import functions as F

from sentrymill import schemas as S
from sentrymill.operators.token_store import TokenStore
from sentrymill.sources.id_store import IdStore

def now():
    return F.lit("2024-02-01 00:00:00Z").cast("timestamp")


def ids(spark, values):
    return spark.createDataFrame([(v,) for v in values], "id long")


def known(store, values, before):
    return sorted(r.id for r in store.known(ids(store.spark, values), before).collect())


def test_ids_over_batches(spark, tmp_path):
    store = IdStore(spark, str(tmp_path / "ids"), 4)
    assert known(store, [1, 2], 0) == []
    for batch in range(4):
        store.add(spark.range(batch * 1000, batch * 1000 + 1000), batch)
    assert known(store, [5, 5, 1500, 3999, 4000, None, -7], 4) == [5, 1500, 3999]
    assert known(store, [5, 1500, 3999], 1) == [5]                     # only what came before
    assert store.files(ids(spark, range(4000, 6000)), 4) == []        # new ids read no file
    assert len(store.files(ids(spark, [1500]), 4)) == 1                # a late one reads its own
    store.add(spark.range(3000, 3500), 3)                               # a repeated batch replaces itself
    assert known(store, [3400, 3600], 4) == [3400]
    store.add(spark.range(0), 4)
    store.compact(2)
    assert known(store, [5, 1500, 3400, 3600], 5) == [5, 1500, 3400]
    assert {f.split("/")[-4] for f in store.files(ids(spark, [5, 2999, 3400]), 5)} == {"snapshot", "batch"}
    store.compact(4)
    store.compact(4)
    assert known(store, [5, 1500, 3400, 3600], 9) == [5, 1500, 3400]


def test_filters_spare_files_of_scattered_ids(spark, tmp_path):
    """Ids without order lie within the bounds of every file; few of them read few files."""
    store = IdStore(spark, str(tmp_path / "ids"), 4)
    for batch in range(6):
        store.add(spark.range(6000).where(F.pmod(F.xxhash64("id"), F.lit(12)) == batch), batch)
    everywhere = store.files(spark.range(6000), 6)
    stranger = [i for i in spark.range(6000).where(F.pmod(F.xxhash64("id"), F.lit(12)) > 6).limit(3).toPandas()["id"]]
    assert len(store.files(ids(spark, [int(i) for i in stranger]), 6)) < len(everywhere) / 3
    all_known = spark.range(6000).where(F.pmod(F.xxhash64("id"), F.lit(12)) < 6).count()
    assert store.known(spark.range(6000), 6).count() == all_known       # a filter never loses an id


def token_rows(spark, rows):
    full = [(s, v, t, t.split("_")[0], int(t.split("_")[1]), i, i, None) for i, (s, v, t) in enumerate(rows)]
    return spark.createDataFrame(full, S.TOKENS)


def later(minutes):
    return now() + F.expr(f"INTERVAL {minutes} MINUTES")


def test_saves_renew_and_expire(spark, tmp_path):
    store = TokenStore(spark, str(tmp_path / "tokens"), 4)
    assert store.version() == 0 and store.load(now()).count() == 0
    first = [("a", "x@y.z", "EMAIL_001"), ("a", "Ann", "PATIENT_001"), ("b", "Bob", "PATIENT_001"), ("c", "Cy", "PATIENT_001")]
    store.save(token_rows(spark, first), now())
    before = store.held()
    store.save(token_rows(spark, [("a", "Zoe", "PATIENT_002"), ("a", "Ann", "PATIENT_009"), (None, "n", "DATE_001")]), later(40))
    after = store.held()
    assert sum(after[b] != before.get(b) for b in after) == 1          # other buckets are not rewritten
    got = lambda m, **k: sorted((r.session_id, r.value, r.token) for r in store.load(later(m), **k).collect())
    kept = [("a", "Ann", "PATIENT_001"), ("a", "Zoe", "PATIENT_002"), ("a", "x@y.z", "EMAIL_001")]
    assert got(50) == kept + [("b", "Bob", "PATIENT_001"), ("c", "Cy", "PATIENT_001")]
    assert got(70) == kept and got(100) == []                           # b and c were not renewed
    assert got(50, version=1) == sorted(first)                          # an old version is whole
    assert got(50, sessions=spark.createDataFrame([("b",), ("q",), (None,)], "session_id string")) == [("b", "Bob", "PATIENT_001")]
    assert store.save(token_rows(spark, []), later(70)) == 2
    store.save(token_rows(spark, [("b", "Bo", "PATIENT_001")]), later(70))
    assert got(75) == sorted(kept + [("b", "Bo", "PATIENT_001")])      # what had expired is gone


def test_numbers_go_on_from_a_stored_map(spark, tmp_path):
    from sentrymill.operators import phi, tokens
    store = TokenStore(spark, str(tmp_path / "tokens"))
    text = lambda n, t: phi.detect(spark.createDataFrame([("s", n, t)], "session_id string, text_seq long, text string"))
    _, given = tokens.pseudonymize(text(1, "Mail a@x.com"), now(), existing=store.load(now()))
    store.save(given, now())
    out, given = tokens.pseudonymize(text(2, "Mail b@x.com or a@x.com"), later(30), existing=store.load(later(30)))
    assert out.first().pseudonymized_text == "Mail EMAIL_002 or EMAIL_001"
    store.save(given, later(30))
    back = tokens.restore(out.withColumnRenamed("pseudonymized_text", "text"), store.load(later(80)), later(80))
    assert back.first().restored_text == "Mail b@x.com or a@x.com"


def test_cost_of_a_batch_does_not_follow_the_stored_rows(spark, tmp_path):
    """Twenty micro-batches with late repeats: the last reads no more files than the third."""
    store = IdStore(spark, str(tmp_path / "ids"), 2)
    read = []
    for batch in range(20):
        own = spark.range(batch * 500, batch * 500 + 500)
        late = ids(spark, [max(0, batch * 500 - 700)])
        read.append(len(store.files(own.unionAll(late), batch)))
        store.add(own, batch)
    assert max(read[2:]) <= 2 and store.known(spark.range(10_500), 20).count() == 10_000


@pytest.mark.parametrize("n", [3, 300])
def test_restore_is_one_rule_for_all_sizes(spark, n):
    """Replacing tokens one after another in the growing text, whatever their number."""
    import random

    from sentrymill.operators import tokens
    rng = random.Random(n)
    values = ["x@y.z", "1 foo", "DATE_001", "PATIENT_002", "00", "002 MRN_00", "SSN_", "EMAIL_0011", "plain", "_001"]
    prefixes = ["PATIENT", "DATE", "MRN", "SSN", "EMAIL"]
    given = [(p, i) for i in range(1, n // 3 + 2) for p in prefixes]
    rows = [("s", f"{rng.choice(values)}", f"{p}_{i:03d}") for p, i in given] + [("s", "long", "PATIENT_0011"), ("t", "other", "PATIENT_001")]
    held = token_rows(spark, rows).withColumn("expires_at", later(60)).withColumn("first_start", F.lit(0).cast("long"))
    pieces = [t for _, _, t in rows] + ["PATIENT_00", "DATE_", "1", "001002", " ", ", ", "a", "_", "MRN_0", "SSN_999"]
    texts = ["PATIENT_001002", "PATIENT_00EMAIL_001", "DATE_001PATIENT_0012", "", "none here", "PATIENT_001" * 50] + [
        "".join(rng.choice(pieces) for _ in range(rng.randint(1, 3 + n // 3))) for _ in range(60)]
    docs = spark.createDataFrame([("s", i, t) for i, t in enumerate(texts)], "session_id string, text_seq long, text string")

    def slow(text):
        count = 0
        for _, value, token in sorted((r for r in rows if r[0] == "s"), key=lambda r: -len(r[2])):
            if token in text:
                text, count = text.replace(token, value), count + 1
        return text, count

    got = {r.text_seq: (r.restored_text, r.restored_count) for r in tokens.restore(docs, held, now()).collect()}
    assert got == {i: slow(t) for i, t in enumerate(texts)}
