import random

from sentrymill.llm import similar


def similarity(a, b):
    sets = []
    for t in (a, b):
        words = (t or "").lower().split()
        sets.append({tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))})
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def test_near_copies_many_bits_apart(make_docs):
    rng = random.Random(4)
    rows, want = [], []
    for i in range(60):
        words = [f"w{rng.randrange(9999)}" for _ in range(120)]
        rows.append((2 * i, " ".join(words)))
        for at in range(8, 120, 120 if i % 2 else 50):    # far copies have more words replaced
            words[at] = "new"
        for at in range(0, 100, 8) if i % 3 == 0 else ():
            words[at] = "other"
        rows.append((2 * i + 1, " ".join(words)))
        want += [2 * i] if similarity(rows[-1][1], rows[-2][1]) >= 0.8 else [2 * i, 2 * i + 1]
    assert 60 < len(want) < 120
    rows += [(200, "one text of this id with enough words"), (200, "a different text of the same id altogether"), (None, rows[0][1]), (None, None), (201, " ")]
    kept = similar.keep_one(make_docs(rows)).collect()
    assert sorted(r.doc_id for r in kept) == sorted(want + [200, 200, 201])


def test_odd_rows(spark, make_docs, odd_rows):
    """Nulls, blanks, repeats and a very long text; columns with the operator's own names."""
    docs = make_docs(odd_rows)
    docs = docs.selectExpr("*", "1 AS node", "2 AS a", "'x' AS _node", "3 AS fp2").drop("fp2")
    kept = similar.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 4, 5, 6, 7, 8, 9, 10, 11]
    assert similar.keep_one(make_docs([])).count() == 0


def test_texts_are_not_broadcast(spark, make_docs, tmp_path, monkeypatch):
    """Copies of a text are next to nothing in a file, by which Spark sizes it."""
    near = " ".join(f"w{i}" for i in range(200))
    make_docs([(1, near), (2, near + " more")]).crossJoin(spark.range(2000)).drop("id").coalesce(1).write.parquet(f"{tmp_path}/docs")
    plans, stored = [], similar.stored
    monkeypatch.setattr(similar, "stored", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or stored(df))
    kept = similar.keep_one(spark.read.parquet(f"{tmp_path}/docs"))
    texts = [p for p in plans if "first(text" in p]
    assert len(texts) == 1 and "BuildLeft" not in texts[0]
    assert [r.doc_id for r in kept.collect()] == [1]
