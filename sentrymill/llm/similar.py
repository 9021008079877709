"""Near-duplicates by 5-word shingles: Jaccard similarity of at least 0.8, computed exactly.

The pairs that SimHash finds are checked first, but texts at 0.8 differ in about 10 of 64
bits, which its keys do not reach. Further candidates share all `ROWS` minima of one of
`BANDS` bands of min-hashes (a pair at 0.8 is missed by all bands with a chance of 0.004,
one at 0.85 of 0.0001). Every candidate is checked on the whole shingle sets. In a bucket
each text is checked with one of them first; then only texts that are not connected yet
are checked with each other, so a group of texts that are all at 0.8 to that one costs its
size, not its square.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentrymill.llm import simhash
from sentrymill.llm.common import component_ids, spread_join, stored, text_bytes

WIDTH = 5
LEAST = 0.8
BANDS, ROWS = 24, 7
_FACTORS = np.random.default_rng(42).integers(0, 2**63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_MASKS = np.random.default_rng(43).integers(0, 2**63, BANDS * ROWS, np.uint64)
_AT_ONCE = 1 << 13                    # shingles permuted at one time


def shingles(text: bytes) -> np.ndarray:
    """Sorted distinct hashes of the runs of `WIDTH` words, A-Z in lower case; a shorter
    text is one run, a blank one none."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: max(1, len(words) - WIDTH + 1)].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(line[s:e]) for s, e in zip(starts, ends[min(WIDTH, len(words)) - 1:].tolist())], np.uint64))


def bands(text: bytes) -> np.ndarray:
    """One key for each band; the number of the band is part of the key."""
    found, least = shingles(text), np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for at in range(0, len(found), _AT_ONCE):
        block = found[at:at + _AT_ONCE]
        for i in range(BANDS * ROWS):
            least[i] = min(least[i], ((block ^ _MASKS[i]) * _FACTORS[i]).min())
    rows = least.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(r.tobytes(), b) for b, r in enumerate(rows)], np.uint64).view(np.int64)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets; of two empty ones 1."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


def _buckets(texts: DataFrame) -> DataFrame:
    """(`key`, `node`, `first`) rows of the buckets that hold more than one text. `first` is
    the least node, so a group that shares many buckets has the same one in all of them."""
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                keys = [bands(t) for t in part.column(1).to_pylist()]
                nodes = np.repeat(part.column(0).to_numpy(zero_copy_only=False), BANDS)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(nodes)], ["key", "node"])

    rows = stored(texts.select("node", text_bytes().alias("t")).mapInArrow(run, "key long, node long"))
    shared = rows.groupBy("key").agg(F.min("node").alias("first"), F.max("node").alias("_last")).where(
        "first <> _last").drop("_last")
    return stored(spread_join(rows.distinct(), shared, ["key"]))


def _checked(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (`a`, `b`) of texts that are similar enough."""
    def run(batches):
        for batch in batches:
            a, b, left, right = (batch.column(i).to_pylist() for i in range(4))
            known = (None, None)
            kept = []
            for i, node in enumerate(a):
                if known[0] != node:
                    known = node, shingles(left[i])
                kept.append(similarity(known[1], shingles(right[i])) >= LEAST)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(kept, pa.bool_()))

    t = texts.select("node", text_bytes().alias("t"))
    with_a = spread_join(pairs, t.withColumnRenamed("node", "a").withColumnRenamed("t", "ta"), ["a"])
    both = spread_join(with_a, t.withColumnRenamed("node", "b").withColumnRenamed("t", "tb"), ["b"])
    return stored(both.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long"))


def keep_one(docs: DataFrame) -> DataFrame:
    """`docs` with one row of each group of near-duplicates kept: the smallest doc_id
    (null last), then the smallest text hash. Groups join texts through any chain of similar
    ones; rows are told apart by doc_id and text, so texts that share a doc_id are judged one
    by one. Blank and null texts are one group, a text under five words is one shingle, and
    of repeated rows one stays. Columns stay as they are, whatever their names; an empty
    table stays empty. Starts jobs when called; texts, keys and links lie in the shared
    folder."""
    node = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), node.alias("node"))
    alike = rows.groupBy("doc_id", "node").agg(F.count("*").alias("n"))
    nodes = stored(alike.groupBy("node").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node", "n")).alias("least")))
    every = docs.select(node.alias("node"), "text")
    held = _buckets(every)
    found = stored(simhash.candidates(every).unionByName(
        held.where("first <> node").select(F.col("first").alias("a"), F.col("node").alias("b"))).distinct())
    # only texts that are compared with another are kept at hand, each once
    met = held.select("node").unionByName(found.select(F.col("a").alias("node"))).unionByName(
        found.select(F.col("b").alias("node"))).distinct()
    # (a semi-join can broadcast the nodes only, never texts that are sized by their compressed file)
    texts = stored(spread_join(every, met, ["node"], "left_semi").groupBy("node").agg(F.first("text").alias("text")))
    near = _checked(found, texts)
    parts = component_ids(nodes, near).select("node", F.xxhash64("component_id").alias("part"))
    placed = stored(spread_join(held.select("key", "node"), parts, ["node"]))
    mixed = placed.groupBy("key").agg(F.min("part").alias("_low"), F.max("part").alias("_high")).where("_low <> _high").select("key")
    apart = stored(spread_join(placed, mixed, ["key"]))
    other = apart.select("key", F.col("node").alias("b"), F.col("part").alias("_part"))
    rest = apart.withColumnRenamed("node", "a").join(other, "key").where("a < b and part <> _part").select("a", "b").distinct()
    links = near.unionByName(_checked(rest, texts))
    chosen = stored(component_ids(nodes, links).select(
        F.col("component_id.doc_id").alias("_near_id"), F.col("component_id.node").alias("_near_text"),
        F.col("component_id.n").alias("_near_n")).distinct())
    kept = docs.join(chosen.hint("rebalance"), F.col("doc_id").cast("long").eqNullSafe(F.col("_near_id"))
                     & (node == F.col("_near_text")))
    # rows alike in id and text are few as a rule; only they are brought together once more
    return kept.where("_near_n = 1").unionByName(
        kept.where("_near_n > 1").dropDuplicates(["_near_id", "_near_text"])).drop("_near_id", "_near_text", "_near_n")
