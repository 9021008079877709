"""Spans against a plain finditer, golden notes, tokens and restoring."""

import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from sentrymill import domains as D
from sentrymill import schemas as S
from sentrymill.operators import phi, tokens
from sentrymill.sources import sample_views as V

AS_OF = "2024-01-01 00:00:00"

NOTES = [
    "Seen by Dr. Mary Jones on 2024-01-02. MRN#123456, SSN 123-45-6789.",
    "DOB: 03/04/1980; call (555) 123-4567 or 555-987-6543.",
    "Mail a@x.com then b@x.com then a@x.com.",
    "Patient John Smith emailed john@x.com",
    "patient was admitted today with Blood Pressure high",
    "Lives at 12 Oak Tree Street. Treated in Mercy General Hospital.",
]
TOKENS_OUT = [
    "Seen by DOCTOR_001 on DATE_001. MRN_001, SSN SSN_001.",
    "DOB_001; call PHONE_002 or PHONE_001.",
    "Mail EMAIL_001 then EMAIL_002 then EMAIL_001.",
    "PATIENT_001 Smith emailed EMAIL_003",
    "patient PATIENT_002 Blood Pressure high",
    "Lives at ADDRESS_001. HOSPITAL_001.",
]
ODD = [
    "", "no data at all", "Ana María García visited Dr Luis Pérez and Dr. Anne Lee Ray Poe",
    "born on March 3, 1999; Date of birth: 1999-03-03; dob 1/2/99", "x\x01John Smith\x01 a@b.co \x02",
    "MRN: 12345678 mrn#0000 MRN 123", "+1 555.123.4567, 1-555-123-4567 5551234567 (555)123-4567",
    "555-1234 and 123 45 6789 and 123-45-67890", "ünïcode Jóhn Smith été Paris France",
    "Jan 5, 2020 and january 15 2021 and 2020-13-45", "44 Some Long Road Avenue, then 9 St, 5 Elm  Court",
    "St Mary's Health Center and Big Clinic and the Clinic", "Client  Jane Roe; subject\nBob Stone Quarry",
    "Heart Rate Blood Type Clinical Note John Doe", "a" * 300 + "@" + "b" * 50 + ".com",
    "١٢٣-٤٥-٦٧٨٩ is an SSN in other digits", "tail John", " Nbsp Name here", None,
]


def brute(text):
    """Rule by rule over plain re matches, dropping what touches a taken character."""
    taken, kept = set(), []
    for name, entity, confidence, ignore_case, lead, body in D.PHI_RULES:
        for m in re.finditer(lead + "(" + body + ")", text, re.I if ignore_case else 0):
            start, end, value = m.start(1), m.end(1), m.group(1).strip()
            if name == "phone" and len(re.sub(r"\D", "", value)) < D.PHONE_DIGITS:
                continue
            if name == "name_pair" and m.group(1) in D.NOT_NAMES:
                continue
            if taken.isdisjoint(range(start, end)):
                taken.update(range(start, end))
                kept.append((start, end, entity, value, confidence))
    return sorted(kept)


def spans_of(df):
    return {r.k: [(e.start, e.end, e.entity_type, e.value, e.confidence) for e in r.entities] for r in df.collect()}


def test_golden_spans(spark):
    df = spark.createDataFrame(list(enumerate(NOTES + ODD)), "k int, text string")
    got = spans_of(phi.detect(df))
    for k, text in enumerate(NOTES + ODD):
        assert got[k] == (brute(text) if text else []), text
    assert [(s, e, t) for s, e, t, _, _ in got[0]] == [
        (8, 22, "DOCTOR_NAME"), (26, 36, "DATE"), (38, 48, "MRN"), (54, 65, "SSN")]
    assert [(s, e, t) for s, e, t, _, _ in got[3]] == [(0, 12, "PATIENT_NAME"), (27, 37, "EMAIL")]


def test_whole_corpus_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select(
        F.col("doc_id").alias("k"), "text")
    got = spans_of(phi.detect(docs))
    for r in docs.collect():
        assert got[r.k] == brute(r.text)


def test_strict_names_need_capitals(spark):
    df = spark.createDataFrame([(0, NOTES[4]), (1, "PATIENT Jane Roe left")], "k int, text string")
    rule = {r.k: [s.value for s in r.spans] for r in phi.find_rule(df, "patient", strict=True).collect()}
    assert rule == {0: [], 1: ["Jane Roe"]}


def test_summary_and_report(spark):
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(NOTES)], "k int, text string, lang string")
    found = phi.summarise(phi.detect(df)).orderBy("k").collect()
    assert [r.entity_count for r in found] == [4, 3, 3, 2, 1, 2]
    assert found[2].entity_types == ["EMAIL"] and found[2].has_phi
    report = {r.entity_type: (r.entities, r.documents) for r in phi.corpus_report(phi.detect(df), "lang").collect()}
    assert report["EMAIL"] == (4, 2) and report["PHONE"] == (2, 1)


def session(spark, texts, name="s", start=0):
    rows = [(name, start + i, t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "session_id string, text_seq long, text string")


def at(extra="0 SECONDS"):
    return F.lit(AS_OF).cast("timestamp") + F.expr(f"INTERVAL {extra}")


def test_golden_tokens_and_restore(spark):
    docs = session(spark, NOTES)
    out, given = tokens.pseudonymize(phi.detect(docs), at())
    assert [r.pseudonymized_text for r in out.orderBy("text_seq").collect()] == TOKENS_OUT
    assert {r.mapping_ttl for r in out.collect()} == {3600}
    texts = out.withColumnRenamed("pseudonymized_text", "text")
    back = tokens.restore(texts, given, at("59 MINUTES")).orderBy("text_seq").collect()
    assert [r.restored_text for r in back] == NOTES
    assert [r.restored_count for r in back] == [4, 3, 2, 2, 1, 2]
    late = tokens.restore(texts, given, at("60 MINUTES")).orderBy("text_seq").collect()
    assert [(r.restored_text, r.restored_count) for r in late] == [(t, 0) for t in TOKENS_OUT]


def test_session_goes_on_and_renews(spark):
    _, first = tokens.pseudonymize(phi.detect(session(spark, NOTES[:3])), at())
    out, both = tokens.pseudonymize(
        phi.detect(session(spark, NOTES[3:], start=3)), at("30 MINUTES"), existing=first)
    assert [r.pseudonymized_text for r in out.orderBy("text_seq").collect()] == TOKENS_OUT[3:]
    assert both.count() == 9 + 5
    assert both.where(F.col("expires_at") != at("90 MINUTES")).count() == 0


def test_sessions_share_nothing(spark):
    docs = session(spark, NOTES[2:3], "a").unionAll(session(spark, ["b@x.com"], "b"))
    out, given = tokens.pseudonymize(phi.detect(docs), at())
    assert {(r.session_id, r.value, r.token) for r in given.collect()} == {
        ("a", "a@x.com", "EMAIL_001"), ("a", "b@x.com", "EMAIL_002"), ("b", "b@x.com", "EMAIL_001")}


def brute_restore(text, table):
    count = 0
    for token, value in sorted(table, key=lambda kv: -len(kv[0])):
        if token in text:
            text, count = text.replace(token, value), count + 1
    return text, count


@pytest.mark.parametrize("text", [
    "EMAIL_001 EMAIL_0011 EMAIL_1000 EMAIL_10000", "UPDATE_001 and xPATIENT_001y", "EMAIL_002 nests",
    "nothing here", "EMAIL_999 unknown", "EMAIL_003 twice nested EMAIL_003",
])
def test_restore_like_a_plain_loop(spark, text):
    table = [("EMAIL_001", "a@x.com"), ("DATE_001", "2024-01-01"), ("PATIENT_001", "Jo Fox"),
             ("EMAIL_002", "DATE_001@x.com"), ("EMAIL_1000", "k@x.com"), ("EMAIL_003", "EMAIL_004@x.com"),
             ("EMAIL_004", "PATIENT_001@y.com")]
    known = spark.createDataFrame(
        [("s", v, t, t.split("_")[0], int(t.split("_")[1]), i, 0, None) for i, (t, v) in enumerate(table)], S.TOKENS
    ).withColumn("expires_at", at("1 HOUR"))
    row = tokens.restore(session(spark, [text]), known, at()).collect()[0]
    assert (row.restored_text, row.restored_count) == brute_restore(text, table)


def _detected(spark, rows):
    return phi.detect(spark.createDataFrame(rows, "session_id string, text_seq long, text string"))


def test_no_text_is_lost_or_mixed(spark):
    rows = [(None, 1, "mail a@x.com"), (None, 1, "mail b@x.com"), ("s", 1, "mail a@x.com"), ("s", 1, "or c@x.com, d@x.com"),
            ("s", None, "mail e@x.com"), ("s", None, None), (None, None, "nothing here"), ("s", 1, "mail a@x.com")]
    out, given = tokens.pseudonymize(_detected(spark, rows), F.lit("2024-01-01").cast("timestamp"))
    got = out.collect()
    assert len(got) == len(rows) and all(r.session_id for r in got)
    texts = sorted((r.pseudonymized_text for r in got), key=str)
    assert all("@" not in (t or "") for t in texts) and texts.count("nothing here") == 1
    assert len([t for t in texts if t and re.fullmatch(r"mail EMAIL_\d{3}", t)]) == 5
    assert len([t for t in texts if t and re.fullmatch(r"or EMAIL_\d{3}, EMAIL_\d{3}", t)]) == 1
    assert len({r.session_id for r in got if r.session_id != "s"}) == 3
    back = tokens.restore(
        out.selectExpr("session_id", "text_seq", "pseudonymized_text AS text"), given, F.lit("2024-01-01").cast("timestamp"))
    assert sorted((r.restored_text for r in back.collect()), key=str) == sorted((t for _, _, t in rows), key=str)


def test_many_entities_in_one_text(spark):
    text = " é ".join(f"user{i}@mail{i % 7}.example.com" for i in range(400)) + " end"
    out, given = tokens.pseudonymize(_detected(spark, [("s", 1, text)]), F.lit("2024-01-01").cast("timestamp"))
    row = out.collect()[0]
    assert row.entity_count == 400 and "@" not in row.pseudonymized_text and row.pseudonymized_text.endswith(" end")
    back = tokens.restore(
        out.selectExpr("session_id", "text_seq", "pseudonymized_text AS text"), given, F.lit("2024-01-01").cast("timestamp"))
    assert back.collect()[0].restored_text == text and back.collect()[0].restored_count == 400


def test_notes_are_dealt_out_before_they_are_searched(spark, tmp_path):
    spark.range(0, 4000, 1, 1).withColumnRenamed("id", "c_custkey").write.parquet(f"{tmp_path}/customer.parquet")
    notes = V.notes(spark, str(tmp_path))
    held = [r[1] for r in notes.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(held) == 4000 and max(held) < 4000 / 4       # one file of keys was one task


def test_restore_reads_its_texts_once(spark, tmp_path):
    """They come from a costly plan: what follows must go on from the stored texts."""
    path = str(tmp_path / "texts")
    spark.createDataFrame(
        [("s", 1, "Seen by EMAIL_001, not EMAIL_002x."), ("s", 2, "nothing"), ("s", 3, None), (None, 4, "EMAIL_001")],
        "session_id string, text_seq long, text string").write.parquet(path)
    known = spark.createDataFrame(
        [("s", "Ann", "EMAIL_001", "EMAIL", 1, 1, 0, datetime(2030, 1, 1)), ("s", "Bo", "EMAIL_002", "EMAIL", 2, 1, 9, datetime(2030, 1, 1))], S.TOKENS)
    back = tokens.restore(spark.read.parquet(path), known, F.lit(datetime(2024, 1, 1)))
    assert sorted((r.text_seq, r.restored_text, r.restored_count) for r in back.collect()) == [
        (1, "Seen by Ann, not Box.", 2), (2, "nothing", 0), (3, None, 0), (4, "EMAIL_001", 0)]
    assert not any(path in f for f in back.inputFiles())
