"""Trees and proofs against building them plainly."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from sentrymill.llm import manifest, queries


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha(*out[-1][i:i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def path(tree, i):
    """(sibling or none, the node is a right child) from a leaf up."""
    steps = []
    for row in tree[:-1]:
        other = i ^ 1
        steps.append((row[other] if other < len(row) else None, i & 1))
        i //= 2
    return steps


def slow(rows, tampered):
    """doc_id, leaf, subroot, root, proof, folded root and verdict of (doc_id, source, lang, n_chars, text) rows."""
    none_first = lambda v: (v is not None, v.encode() if isinstance(v, str) else v)
    langs = sorted({r[2] for r in rows}, key=none_first)
    held = [sorted((r for r in rows if r[2] == x), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for x in langs]
    trees = [levels([leaf(r) for r in own]) for own in held]
    top = levels([t[-1][0] for t in trees])
    out = []
    for k, (own, tree) in enumerate(zip(held, trees)):
        for i, row in enumerate(own):
            steps = path(tree, i) + path(top, k)
            h = leaf(row[:3] + (None if row[3] is None else row[3] + 1,) + row[4:]) if tampered(row) else leaf(row)
            for sibling, right in steps:
                h = sha(*([h] if sibling is None else [sibling, h] if right else [h, sibling]))
            proof = sha(*(s for s, _ in steps if s))
            out.append((row[0], leaf(row), tree[-1][0], top[-1][0], proof, h, h == top[-1][0]))
    return out


def by_seven(row):
    return row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0


def rows_of():
    rng = random.Random(6)
    rows = [(i, f"s{i % 3}" if i % 5 else None, rng.choice(["en", "en", "en", "Zé", "é", "z", None]),
             i * 3 if i % 11 else None, rng.choice(["", "täxt", None, "x" * 3000]) if i % 2 else f"text {i}") for i in range(900)]
    rows += [(-5, "s", "alone", 1, "t"), (2**62 + 1, "s", "en", 2**40, "big"), (None, None, None, None, None), (None, "s", "en", 1, "x")]
    rows += [rows[10]] * 300 + [(10, "other", rows[10][2], 4, "same id")]
    rng.shuffle(rows)
    return rows


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def run(docs):
    claim = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0,
                   manifest.leaf_hash("doc_id", "source", "lang", F.col("n_chars") + 1, "text"))
    rows = manifest.proofs(manifest.build(docs, claim=claim)).select(
        "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()
    return sorted((tuple(r) for r in rows), key=str)


@pytest.mark.parametrize("high", [2, 3, 10])
def test_proofs(spark, monkeypatch, high):
    monkeypatch.setattr(manifest, "LEVELS", high)
    monkeypatch.setattr(manifest, "ROWS_PER_PART", 100)
    rows = rows_of()
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("h", F.lit("clash")).withColumn("tree", F.lit(1)).withColumn(
        "level", F.lit(2)).withColumn("idx", F.lit(3)).withColumn("key", F.lit("k")).withColumn("n", F.lit(9))
    got = run(docs)
    assert got == sorted(slow(rows, by_seven), key=str)
    assert {r[6] for r in got} == {True, False}


@pytest.mark.parametrize("n", [1, 2, 3, 5, 8, 17])
def test_small_trees(spark, monkeypatch, n):
    monkeypatch.setattr(manifest, "LEVELS", 2)
    rows = [(i, "s", "en", i, f"t{i}") for i in range(n)]
    assert run(spark.createDataFrame(rows, SCHEMA)) == sorted(slow(rows, by_seven), key=str)


def test_many_trees(spark, monkeypatch):
    monkeypatch.setattr(manifest, "LEVELS", 2)
    rows = [(i, "s", f"l{i // 2}", i, f"t{i}") for i in range(90)]
    assert run(spark.createDataFrame(rows, SCHEMA)) == sorted(slow(rows, by_seven), key=str)


def test_empty(spark):
    made = manifest.build(spark.createDataFrame([], SCHEMA))
    assert made.root is None and manifest.proofs(made).count() == 0


def test_missing_is_the_least_union():
    rng = random.Random(2)
    for _ in range(200):
        n = rng.randint(1, 70)
        known = sorted(rng.sample(range(n), rng.randint(1, n)))
        asked = manifest.missing(known, n)
        tree = levels([str(i) for i in range(n)])
        need, have = set(), set()
        for i in known:
            for level in range(len(tree)):
                have.add((level, i >> level))
                if level < len(tree) - 1 and (i >> level) ^ 1 < len(tree[level]):
                    need.add((level, (i >> level) ^ 1))
        assert sorted(asked) == sorted(need - have)


def test_query_tells_tampered_rows(spark, sample):
    got = {r.doc_id: r.verified for r in queries.QUERIES["op13_manifest"](spark, "/root/testdata/sf0.001").collect()}
    docs = sample("documents").select("doc_id", "n_chars").collect()
    assert got == {r.doc_id: r.n_chars is None or zlib.crc32(str(r.doc_id).encode()) % 7 != 0 for r in docs}
