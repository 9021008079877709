"""Near-duplicates by 64-bit SimHash, matched with Golay-code fuzzy hashing.

Fingerprints differ in at most three bits if and only if, cut into three segments, either
one segment is equal and one of the other two differs in at most one bit, or all three
differ in exactly one. A segment (zero-filled to 23 bits) is decoded with the perfect
[23,12] Golay code. The codeword nearest to a word one bit away is among the codewords
nearest to the 1-bit neighbours of the segment, of which there are at most six. So one
side of a join carries the decoded index of each segment and the other side all indices
of the neighbours, beside the equal segment: keys of 34 to 36 bits. Every candidate is
verified on the whole fingerprint.
"""

from __future__ import annotations

from itertools import combinations, permutations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentrymill.llm.common import component_ids, spread_join, stored, text_bytes

SHINGLE = 3
SEED = 42
BITS = 3                              # the keys find links of up to three bits
SEGMENTS = ((0, 22), (22, 21), (43, 21))   # first bit and width
_GENERATOR = 0b101011100011           # of the [23,12,7] Golay code
_AT_ONCE = 1 << 16                    # shingles whose bits are held at one time


def fingerprint(text: bytes) -> int:
    """The SimHash of one text; see op1_simhash for the rule."""
    words = text.lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) < SHINGLE:
        hashes = [digest(b" ".join(words), SEED)]
    else:
        line = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - SHINGLE + 1].tolist()
        hashes = [digest(line[s:e], SEED) for s, e in zip(starts, ends[SHINGLE - 1:].tolist())]
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _AT_ONCE):
        block = np.array(hashes[at:at + _AT_ONCE], np.uint64).view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view(np.int64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """`doc_id` and `fp` (long) of every row; a null or blank text has fingerprint 0."""
    def run(batches):
        for batch in batches:
            fps = [fingerprint(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("t")).mapInArrow(
        run, "doc_id long, fp long")


def _remainders(width: int, shift: int) -> np.ndarray:
    """Remainder by the generator of every `width`-bit word moved up by `shift`."""
    words = np.arange(1 << width, dtype=np.int64) << shift
    for bit in range(22, 10, -1):
        words = np.where(words >> bit & 1, words ^ (_GENERATOR << (bit - 11)), words)
    return words


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    low, high = _remainders(11, 0), _remainders(12, 11)
    errors = np.zeros(2048, np.int64)
    for weight in range(1, 4):
        for at in combinations(range(23), weight):
            word = sum(1 << b for b in at)
            errors[low[word & 2047] ^ high[word >> 11]] = word
    return low, high, errors


_LOW, _HIGH, _ERRORS = _tables()


def decode(words: np.ndarray) -> np.ndarray:
    """Index (12 bits) of the one codeword within three bits of each 23-bit word."""
    return (words ^ _ERRORS[_LOW[words & 2047] ^ _HIGH[words >> 11]]) >> 11


def near_indices(words: np.ndarray, width: int) -> np.ndarray:
    """Indices that the words within one bit decode to, at most six, one row for each
    word; -1 fills up."""
    flips = np.concatenate([[0], 1 << np.arange(width)])
    found = np.sort(decode(words[:, None] ^ flips[None, :]), axis=1)
    found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
    return -np.sort(-found, axis=1)[:, :6]


def _keys(fps: np.ndarray, probe: bool) -> tuple[np.ndarray, np.ndarray]:
    """(key, fingerprint) rows of one side. Keys of different cases never meet: the case
    number is in the top bits."""
    cut = [(fps >> first) & ((1 << width) - 1) for first, width in SEGMENTS]
    one = [decode(s)[:, None] for s in cut]
    many = [near_indices(s, width) for s, (_, width) in zip(cut, SEGMENTS)]
    keys, owners = [], []

    def add(key, known):
        rows, _ = np.nonzero(known)
        keys.append(key[known])
        owners.append(fps[rows])

    for case, (a, b) in enumerate(permutations(range(3), 2)):
        index = many[b] if probe else one[b]
        add((case << 40) | (cut[a][:, None] << 12) | index, index >= 0)
    x, y, z = (many[0], many[1], one[2]) if probe else (one[0], one[1], many[2])
    known = (x >= 0)[:, :, None, None] & (y >= 0)[:, None, :, None] & (z >= 0)[:, None, None, :]
    whole = (6 << 40) | (x[:, :, None, None] << 24) | (y[:, None, :, None] << 12) | z[:, None, None, :]
    add(whole.reshape(len(fps), -1), known.reshape(len(fps), -1))
    return np.concatenate(keys), np.concatenate(owners)


def fuzzy_keys(fps: DataFrame, probe: bool) -> DataFrame:
    """(`key`, `fp`) rows of distinct fingerprints for one side of the join."""
    def run(batches):
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(values), 4096):
                key, fp = _keys(values[at:at + 4096], probe)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp)], ["key", "fp"])

    return fps.select("fp").mapInArrow(run, "key long, fp long")


def links(fps: DataFrame, bits: int = BITS) -> DataFrame:
    """Pairs (`a` < `b`) of distinct fingerprints that differ in at most `bits` bits.

    `fps` holds distinct, non-null `fp`. Only fingerprints go through the join: copies of
    a text are one fingerprint, whatever their number. Spark sizes the keys by the
    fingerprints, but each makes dozens of rows, so neither side may be broadcast.
    """
    if not 0 <= bits <= BITS:
        raise ValueError(f"bits must be from 0 to {BITS}")
    index = fuzzy_keys(fps, False).withColumnRenamed("fp", "a")
    probe = fuzzy_keys(fps, True).withColumnRenamed("fp", "b")
    return (
        index.join(probe.hint("merge"), "key")
        .where(f"a < b and bit_count(a ^ b) <= {bits}")
        .select("a", "b").distinct()
    )


def near_duplicates(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """One row per input row: `doc_id`, `fingerprint` (16 hex digits), `component_id`.

    Components join all documents whose fingerprints are linked through any chain of
    links of at most `bits` bits; `component_id` is the smallest non-null doc_id in it.
    Null and blank texts have fingerprint zero and are linked like any other. Repeated
    rows and copies share their component. A row with null doc_id keeps its place in a
    component (component_id null if it has no other rows). Extra columns are ignored; no
    rows give no rows. Starts Spark jobs when called and keeps fingerprints, links and
    components in the shared folder.
    """
    fps = stored(fingerprints(docs))
    nodes = stored(fps.groupBy(F.col("fp")).agg(F.min("doc_id").alias("least")))
    ids = component_ids(nodes.withColumnRenamed("fp", "node"), links(nodes, bits))
    # copies take next to nothing in the file that Spark sizes the rows by, so they are never broadcast
    return spread_join(fps.hint("merge"), ids.withColumnRenamed("node", "fp"), ["fp"]).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def candidates(texts: DataFrame, bits: int = BITS) -> DataFrame:
    """Pairs (`a`, `b`) of different texts that SimHash finds alike, for an exact check.

    `texts` holds `node` (long, one for each text) and `text`; rows may repeat. A text is paired with the least node
    of its fingerprint, and the least nodes of linked fingerprints with each other, so
    pairs go with the texts, not with the square of a fingerprint's.
    """
    fps = stored(fingerprints(texts.select(F.col("node").alias("doc_id"), "text")).distinct())
    first = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    same = spread_join(fps, first, ["fp"]).where("doc_id <> least").select(
        F.col("least").alias("a"), F.col("doc_id").alias("b"))
    linked = links(first, bits)
    one = first.select(F.col("fp").alias("a"), F.col("least").alias("_a"))
    two = first.select(F.col("fp").alias("b"), F.col("least").alias("_b"))
    return same.unionByName(
        spread_join(spread_join(linked, one, ["a"]), two, ["b"]).select(F.col("_a").alias("a"), F.col("_b").alias("b")))


def keep_one(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """`docs` with one row of each component kept: the one whose doc_id is the component's
    smallest. Of rows repeated with that doc_id one stays, with the smallest text hash;
    rows with null doc_id have no id to be judged by and all stay."""
    kept = near_duplicates(docs, bits).where("doc_id = component_id").select(
        F.col("doc_id").alias("_kept")).distinct()
    least = docs.where("doc_id is not null").groupBy(F.col("doc_id").alias("_kept")).agg(
        F.min(F.xxhash64("text")).alias("_text"))
    chosen = least.join(kept, "_kept", "left_semi").hint("rebalance")
    return docs.where("doc_id is null").unionByName(
        docs.join(chosen, (F.col("doc_id") == F.col("_kept")) & (F.xxhash64("text") == F.col("_text")))
        .drop("_kept", "_text").dropDuplicates(["doc_id"])
    )
