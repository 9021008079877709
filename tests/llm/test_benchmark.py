"""Benchmark passages against a plain account of the rules, and clean documents left alone."""

import random
import re
import time
from collections import Counter

import pytest

from sentrymill.llm import benchmark


def slow_tokens(text):
    """(plain token, template token, is a slot) of every word with a core."""
    out, opens, after_number = [], True, False
    for word in re.findall(r"[^\x20\x09-\x0D]+", text or ""):
        core = word.strip(benchmark.EDGE)
        low = core.lower()
        if benchmark.NUMBER.fullmatch(core):
            kind = "<number>"
        elif low in benchmark.UNITS:
            kind = "<unit>" if after_number else None
        elif core[:1].isupper() and not core.isupper():
            kind = None if opens else "<name>"
        else:
            kind = None
        if core:
            out.append((low, kind or low, kind is not None))
        after_number = bool(benchmark.NUMBER.fullmatch(core))
        opens = word.rstrip("\"')]}").endswith((".", "!", "?", ":"))
    return out


def slow_found(text, item):
    """(share, longest verbatim run, a slot changed) by comparing every window with every other."""
    mine, theirs = slow_tokens(item), slow_tokens(text)
    if not mine:
        return 0.0, 0, False
    width = min(8, len(mine))
    passages = {}
    for b in range(len(mine) - width + 1):
        for d in range(len(theirs) - width + 1):
            m, t = mine[b:b + width], theirs[d:d + width]
            if [x[0] for x in m] == [x[0] for x in t]:
                passages.setdefault(d - b, set()).add((b, (), ()))
            slots = sum(x[2] for x in m)
            if [x[1:] for x in m] == [x[1:] for x in t] and slots and width - slots >= max((width + 1) // 2, min(4, width)):
                passages.setdefault(d - b, set()).add((b, tuple(x[0] for x in m if x[2]), tuple(x[0] for x in t if x[2])))
    covered, best, changed = set(), 0, False
    for windows in passages.values():
        votes, there = Counter(p for _, m, t in windows for p in zip(m, t)), {}
        for x in {x for x, _ in votes}:
            most = max(n for (y, _), n in votes.items() if y == x)
            there[x] = [t for (y, t), n in votes.items() if y == x and n == most]
        plain = set()
        for b, m, t in windows:
            if all(y in there[x] for x, y in zip(m, t)):
                covered |= set(range(b, b + width))
                changed |= m != t
                plain |= {b} if not m else set()
        run = 0
        for b in range(len(mine)):
            run = run + 1 if b in plain else 0
            best = max(best, run + width - 1 if run else 0)
    return len(covered) / len(mine), best, changed


def words(rng, n, kind):
    make = {
        "number": lambda: str(rng.randint(1, 99)), "name": lambda: rng.choice(["Anna", "Otto", "Paul", "Berta", "Carla", "Quentin"]),
        "code": lambda: f"w{rng.randint(1, 500)}", "word": lambda: rng.choice("a river bends near old town walls while many small boats pass under bridges".split()),
    }[kind]
    return " ".join(make() for _ in range(n))


QUESTION = "If {p} walks {n} km in {h} hours and then rests with {q} before going on, how far from the old town is {p} when evening comes"


def cases():
    rng = random.Random(5)
    items = [(1, QUESTION.format(p="Anna", q="Otto", n=9, h=2)), (2, words(rng, 30, "number")), (3, words(rng, 30, "name")),
             (4, "Name the winners of the race: " + words(rng, 12, "name")), (5, words(rng, 30, "code")),
             (6, words(rng, 150, "word") + " " + " ".join(f"rare{i}" for i in range(60)) + " " + words(rng, 60, "code")),
             (7, "three short words"), (8, ""), (9, None), (7, "three short words")]
    docs = [(100 + i, words(rng, n, kind)) for i, (n, kind) in enumerate((n, k) for n in (60, 200) for k in ("number", "name", "code"))]
    docs += [
        (1, "so. " + items[0][1] + " the end"), (2, "And now: " + QUESTION.format(p="Berta", q="Paul", n=70, h=5)),
        (3, QUESTION.format(p="Anna", q="Anna", n=4, h=4)), (4, items[1][1]), (5, "x " + items[2][1].upper()),
        (6, "We met Otto Paul Quentin Berta Anna Carla Otto Paul and left."), (7, "here " + " ".join(items[5][1].split()[150:175]) + " there"),
        (8, "here are three short words indeed"), (9, " ".join(f"rare{i}" for i in range(12))), (10, None), (11, ""),
        (12, QUESTION.format(p="w1", q="w2", n="w3", h="w4")), (None, items[0][1]), (6, items[0][1]),
    ]
    return docs, items


def test_equals_a_plain_account(spark, make_docs):
    docs, items = cases()
    got = {(r.doc_id, r.item_id): (round(r.share, 9), r.verbatim, r.reparameterised) for r in benchmark.contaminated(
        make_docs(docs), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {}
    for doc, text in docs:
        for item, passage in items:
            share, run, changed = slow_found(text, passage)
            if share >= 0.5 or run >= 13:
                want[doc, item] = max(want.get((doc, item), (0, 0, False)), (round(share, 9), run, changed))
    assert got == want
    assert {(1, 1), (2, 1), (3, 1), (4, 2), (5, 3), (7, 6), (8, 7), (None, 1), (6, 1)} == set(got)


def test_a_row_is_judged_by_its_own_text(spark, make_docs):
    docs, items = cases()
    kept = benchmark.drop_contaminated(make_docs(docs), spark.createDataFrame(items, "item_id long, text string")).collect()
    left = Counter((r.doc_id, r.text) for r in kept)
    clean = [d for d in docs if not any(s >= 0.5 or r >= 13 for s, r, _ in (slow_found(d[1], t) for _, t in items))]
    assert left == Counter(clean) and (6, docs[11][1]) in left and (None, items[0][1]) not in left


@pytest.mark.parametrize("kind", ["number", "name"])
def test_tables_cost_in_proportion(spark, make_docs, kind):
    rng = random.Random(1)
    items = spark.createDataFrame([(i, words(rng, 30, kind)) for i in range(20)], "item_id long, text string")

    def run(n):
        docs = make_docs([(i, words(rng, n, kind)) for i in range(8)])
        start = time.time()
        assert benchmark.contaminated(docs, items).count() == 0
        return time.time() - start

    run(100)
    short, long = run(500), run(2000)
    assert long < 4 * short + 3


def test_a_long_verbatim_part_of_a_long_item(spark, make_docs):
    item = " ".join(f"w{i}" for i in range(180))
    parts = {1: item.split()[60:120], 2: item.split()[60:73], 3: item.split()[60:72], 4: [f"w{i + 500}" for i in range(180)]}
    got = {r.doc_id: r.verbatim for r in benchmark.contaminated(
        make_docs([(d, "so " + " ".join(p) + " on") for d, p in parts.items()]),
        spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert got == {1: 60, 2: 13}


def test_windows_of_documents_are_not_broadcast(spark, make_docs, tmp_path, monkeypatch):
    """With a large benchmark every window of a document comes, and Spark sizes them by the
    documents."""
    items = [(i, " ".join(f"i{i}w{j}" for j in range(30))) for i in range(300)]
    make_docs([(1, "before it " + items[7][1] + " after it"), (2, "nothing of it")]).coalesce(1).write.parquet(f"{tmp_path}/docs")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/items")
    docs, items = (spark.read.parquet(f"{tmp_path}/{n}") for n in ("docs", "items"))
    for sent in (benchmark.SENT_HASHES, 10):
        monkeypatch.setattr(benchmark, "SENT_HASHES", sent)
        found = benchmark.contaminated(docs, items)
        assert sent > 10 or "SortMergeJoin [h#" in found._jdf.queryExecution().executedPlan().toString()
        assert [(r.doc_id, r.item_id, r.share) for r in found.collect()] == [(1, 7, 1.0)]
