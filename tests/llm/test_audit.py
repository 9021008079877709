"""Filter interactions against counting every order by hand."""

import itertools
import math
import random
import re
from collections import Counter

from sentrymill.llm import audit, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow_fails(rows):
    """Letters each (doc_id, text, part) row fails."""
    out = []
    for doc, text, _ in rows:
        t = text or ""
        words = WORD.findall(t)
        fails = {
            "A": len(words) < 50,
            "B": 100 * len(set(words)) < 65 * len(words),
            "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)),
            "E": doc is not None and any(o is not None and o < doc and (u or "") == t for o, u, _ in rows),
        }
        out.append({k for k, v in fails.items() if v})
    return out


def slow_report(rows, good, toxic):
    fails, report = slow_fails(rows), []
    for part in {p or "" for _, _, p in rows}:
        own = [(f, doc in good, doc in toxic) for f, (doc, _, p) in zip(fails, rows) if (p or "") == part]
        took = Counter()
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, letter in enumerate(order, 1):
                gone = [x for x in left if letter in x[0]]
                left = [x for x in left if letter not in x[0]]
                took[letter] += len(gone)
                report.append([part, "".join(order), step, len(left), len(gone),
                               sum(letter in x[0] for x in own) - len(gone), sum(x[0] == {letter} for x in own),
                               sum(x[1] for x in gone), sum(x[2] for x in gone), letter])
        for row in report:
            if row[0] == part:
                row[9] = took[row[9]]
    return sorted(map(tuple, report))


def rows_of(odd_rows):
    rng, rows = random.Random(4), [(d, t, None if i % 3 else "s0") for i, (d, t) in enumerate(odd_rows)]
    for i in range(120):
        words = [rng.choice(["alpha", "BETA", "gamma%", "d|e", "ete", f"u{rng.random()}"]) for _ in range(rng.randint(30, 80))]
        rows.append((1000 + i, " ".join(words), f"s{i % 3}"))
    rows += [(500 + i, "one text of very many rows", f"s{i % 4}") for i in range(200)]
    return rows + rows[20:40] + [(None, rows[30][1], "s1"), (7, "Äöü É", "")]


def test_audit(spark, make_docs, odd_rows):
    rows = rows_of(odd_rows)
    labels = [(d, i % 2, (i // 2) % 2) for i, (d, _, _) in enumerate(rows)] + [(None, 1, 1), (1, None, None), (9999, 1, 1)]
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    docs = make_docs([(d, t, p) for d, t, p in rows])
    got = audit.audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert sorted(tuple(r) for r in got.collect()) == slow_report(rows, good, toxic)


def test_empty(spark, make_docs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.audit(make_docs([]), labels).count() == 0
    assert audit.audit(make_docs([(1, "a", "s")]), labels).count() == 600


def test_swaps_lead_through_all_orders():
    for width in (1, 2, 3, 4, 5):
        order, seen = list(range(width)), {tuple(range(width))}
        for k in audit.adjacent_swaps(width):
            order[k], order[k + 1] = order[k + 1], order[k]
            seen.add(tuple(order))
        assert len(seen) == math.factorial(width)


def test_diagram_shares_and_keeps_counts():
    rng = random.Random(1)
    counts = {m: (rng.randint(0, 9), m % 2, 1) for m in range(32) if rng.random() < 0.7}
    diagram = audit.Diagram(counts, 5)
    for k in audit.adjacent_swaps(5):
        diagram.swap(k)
        prior = 0
        for which, kept, removed in diagram.steps():
            bit = 1 << which
            expect = [tuple(map(sum, zip((0, 0, 0), *[c for m, c in counts.items() if not m & prior and bool(m & bit) == side])))
                      for side in (False, True)]
            assert [kept, removed] == expect
            prior |= bit
    same = audit.Diagram({m: (1,) for m in range(32)}, 5)
    assert [len(n) for n in same.nodes] == [1] * 5      # equal halves are one node


def test_query_covers_the_sample(spark):
    got = queries.QUERIES["op11_filter_audit"](spark, "/root/testdata/sf0.001")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    kept = got.where("filter_order = 'ABCDE' and step = 1").selectExpr("sum(kept + removed) as n").first().n
    assert kept == docs.count()
