import re
from collections import defaultdict

import numpy as np
import xxhash

from sentrymill.llm import simhash


def slow_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(rows):
    fps = [(i, slow_fingerprint(t)) for i, t in rows]
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i][1] ^ fps[j][1]).count("1") <= 3:
                parent[root(i)] = root(j)
    groups = defaultdict(list)
    for i in range(len(fps)):
        groups[root(i)].append(fps[i][0])
    least = {r: min((d for d in ids if d is not None), default=None) for r, ids in groups.items()}
    return [(fps[i][0], f"{fps[i][1]:016x}", least[root(i)]) for i in range(len(fps))]


def same(df, rows):
    key = lambda r: tuple((v is None, v if v is not None else 0) for v in r)
    assert sorted(map(tuple, df.collect()), key=key) == sorted(slow_components(rows), key=key)


def test_whole_sample_against_brute_force(sample):
    docs = sample("documents")
    same(simhash.near_duplicates(docs), [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def test_odd_rows(make_docs, odd_rows):
    same(simhash.near_duplicates(make_docs(odd_rows)), odd_rows)
    assert simhash.near_duplicates(make_docs([])).count() == 0


def test_keys_find_every_pair_up_to_three_bits():
    rng = np.random.default_rng(3)
    base = rng.integers(-2**63, 2**63 - 1, 500)
    assert len(np.unique(np.concatenate([[0], simhash._ERRORS]))) == 2048     # a perfect code
    for flips in range(4):
        other = base.copy().view(np.uint64)
        for i in range(len(other)):
            for b in rng.choice(64, flips, replace=False):
                other[i] ^= np.uint64(1) << np.uint64(b)
        found = defaultdict(set)
        for k, f in zip(*simhash._keys(base, False)):
            found[f].add(k)
        probes = defaultdict(set)
        for k, f in zip(*simhash._keys(other.view(np.int64), True)):
            probes[f].add(k)
        assert all(found[x] & probes[y] for x, y in zip(base, other.view(np.int64)))


def test_chains_of_links_are_one_component(spark):
    fps = [(1 << n) - 1 for n in range(0, 60, 3)]
    nodes = spark.createDataFrame([(f,) for f in fps], "fp long")
    found = simhash.links(nodes).collect()
    assert len(found) == len(fps) - 1
    from sentrymill.llm.common import components
    roots = components(spark.createDataFrame([(r.a, r.b) for r in found], "a long, b long")).collect()
    assert {r.root for r in roots} == {0} and len(roots) == len(fps) - 1


def test_keys_are_not_broadcast(spark):
    """Each fingerprint makes dozens of keys, which Spark takes for one: on some 100,000 texts
    the broadcast of a table sized at 4 MB filled the driver's memory."""
    nodes = spark.range(1000).selectExpr("xxhash64(id) AS fp")
    for bits in (0, 3):
        plan = simhash.links(nodes, bits)._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_rows_of_copies_are_not_broadcast(spark, make_docs):
    docs = make_docs([(1, "one two three"), (2, "four five six")]).crossJoin(spark.range(500))
    plan = simhash.near_duplicates(docs)._jdf.queryExecution().executedPlan().toString()
    assert re.search("BroadcastHashJoin|SortMergeJoin", plan)[0] == "SortMergeJoin"


def test_one_of_each_group_stays(make_docs, odd_rows):
    kept = simhash.keep_one(make_docs(odd_rows)).collect()
    assert len(kept[0]) == 11
    ids = [r.doc_id for r in kept]
    assert ids.count(None) == 2 and ids.count(8) <= 1 and {1, 4, 7} <= set(ids) and not {2, 3} & set(ids)
