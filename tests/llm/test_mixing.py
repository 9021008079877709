import random

import pytest

from sentrymill.llm import mixing


def slow_targets(sizes):
    """Targets by sharing and capping until nothing is above its cap."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    capped, open_ = {}, set(names)
    while True:
        left = sum(sizes.values()) - sum(capped.values())
        share = {s: left * weight[s] / sum(weight[t] for t in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not over:
            return {**capped, **share}
        capped.update({s: 3.0 * sizes[s] for s in over})
        open_ -= over


def test_targets(spark, make_docs):
    rng = random.Random(5)
    rows = []
    for i in range(900):
        source = rng.choice(["a", "B", "cé", "d", None, "\U0001f600", "e", "empty"])
        rows.append((i, "w " * (0 if source == "empty" else rng.choice([1, 4, 400 if source == "a" else 2])), source))
    got = {r.source: r for r in mixing.targets(mixing.sizes(make_docs(rows))).collect()}
    want = slow_targets({s: r.source_size for s, r in got.items()})
    for s, r in got.items():
        assert r.target == pytest.approx(want[s], rel=1e-9, abs=1e-6)
    assert got["empty"].target == 0 and sum(r.target for r in got.values()) == pytest.approx(sum(r.source_size for r in got.values()))


@pytest.mark.parametrize("chunk", [1000, 20])
def test_words_taken(sample, monkeypatch, chunk):
    monkeypatch.setattr(mixing, "CHUNK", chunk)
    docs = sample("documents")
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count()
    taken, target = {}, {}
    for r in rows:
        assert 0 <= r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[r.source_size, r.target] = taken.get((r.source_size, r.target), 0) + r.taken
    for (size, goal), words in taken.items():
        assert abs(words - goal) <= max(60, 0.03 * goal), (size, goal, words)
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted((r.doc_id, r.taken) for r in rows) == sorted((r.doc_id, r.taken) for r in again)


def test_small_sources_beside_a_large_one(make_docs):
    rng = random.Random(11)
    counts = {"big": 1300, **{f"s{i:02d}": n for i, n in enumerate([12, 30, 50, 200, 900] * 3)}}
    rows = [(i, "w " * max(1, int(rng.lognormvariate(3.5, 0.8))), s)
            for i, s in enumerate(s for s, n in counts.items() for _ in range(n))]
    taken, goal = {}, {}
    source = {i: s for i, _, s in rows}
    weights = [2000 if s == "big" else n for s, n in sorted(counts.items())]
    for r in mixing.mix(make_docs(rows), weights).collect():
        taken[source[r.doc_id]] = taken.get(source[r.doc_id], 0) + r.taken
        goal[source[r.doc_id]] = r.target
    off = {s: abs(taken[s] - goal[s]) / goal[s] for s in counts}
    assert max(off.values()) < 0.02, off


def test_flight_keeps_the_totals():
    rng = random.Random(1)
    size = [rng.randint(1, 5000) for _ in range(500)]
    chance = [0.37] * 500
    before = sum(chance), sum(p * s for p, s in zip(chance, size))
    left = mixing.flight(chance, size, rng)
    assert len(left) <= 2 and all(p in (0.0, 1.0) or i in left for i, p in enumerate(chance))
    assert sum(chance) == pytest.approx(before[0]) and sum(p * s for p, s in zip(chance, size)) == pytest.approx(before[1])


def test_odd_rows(make_docs, odd_rows):
    rows = mixing.mix(make_docs(odd_rows)).collect()
    assert len(rows) == len(odd_rows)
    assert all(r.size == r.taken == 0 for r in rows if r.doc_id in (1, 2, 3))
    assert mixing.mix(make_docs([])).count() == 0
    assert [r.taken for r in mixing.mix(make_docs([(1, None), (2, "")])).collect()] == [0, 0]


def test_mixed_documents(make_docs, odd_rows):
    docs = make_docs(odd_rows).drop("size")
    took = sum(r.taken for r in mixing.mix(docs).collect())
    rows = mixing.mixed_documents(docs)
    assert sum(r.taken for r in rows.collect()) == took and set(docs.columns) < set(rows.columns)
    assert all(r.taken > 0 for r in rows.collect())


def test_repeated_rows_do_not_fill_one_chunk(spark, make_docs, monkeypatch):
    """Half the table is one row: no chunk gets more than twice its size."""
    from pyspark.sql import functions as F
    rows = [(1, "the same text over and over", "s0")] * 3000 + [(10 + i, f"text number {i}", "s0") for i in range(3000)]
    monkeypatch.setattr(mixing, "CHUNK", 100)
    dealt = mixing.copies(mixing.sizes(make_docs(rows))).withColumn("chunk", F.expr("pmod(seq, 60)"))
    most = max(r["count"] for r in dealt.groupBy("chunk").count().collect())
    assert dealt.count() == 6000 and most <= 200
    got = mixing.mix(make_docs(rows)).collect()
    assert len(got) == 6000 and abs(sum(r.taken for r in got) / got[0].target - 1) < 0.02


def test_columns_of_the_result_replace_their_namesakes(spark, make_docs):
    docs = make_docs([(1, "a b c", "s"), (2, "d e", "t")]).selectExpr("*", "'x' AS target", "7 AS taken")
    out = mixing.mixed_documents(docs)
    assert len(set(out.columns)) == len(out.columns) and all(r.taken > 0 and r.size in (2, 3) for r in out.collect())
