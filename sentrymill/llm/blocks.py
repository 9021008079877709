"""Counting keys of texts over the whole corpus, block by block.

Texts are dealt to blocks of a few million characters. A block asks for the totals of its
distinct keys: one row for each part of the count tables, with the hashes packed and
sorted and how often the block has each. A part adds up what all blocks report and
answers each with totals in the order asked. So a hash travels once for each block that
has it, however often it occurs there, an answer is a few bits, and a block finds its
totals again by making the same keys from the same texts.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentrymill.llm.common import parts_of, spread_join, stored

BLOCK_CHARS = 2_000_000
PART_CHARS = 32_000_000   # of text whose keys one part of the count tables holds
_ASK = "part long, block long, kind int, k1 binary, k2 binary, n binary"
_TOLD = "block long, part long, kind int, n binary"


def word_codes(texts: pa.Array) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """Words of all texts in order as numbers into a list of distinct words, and how many
    each text has. Splits at the six ASCII white-space characters."""
    texts = pa.concat_arrays(texts.chunks) if isinstance(texts, pa.ChunkedArray) else texts
    split = pc.ascii_split_whitespace(pc.fill_null(texts, "").cast(pa.large_string()))
    counts = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = split.flatten()
    coded = flat.dictionary_encode()
    at = coded.indices.to_numpy(zero_copy_only=False)
    full = pc.not_equal(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False).astype(bool)
    if not full.all():          # a text that opens or ends with a space has an empty piece there
        text = np.repeat(np.arange(len(counts)), counts)[full]
        counts, at = np.bincount(text, minlength=len(counts)).astype(np.int64), at[full]
    return at, coded.dictionary.cast(pa.large_binary()).to_pylist(), counts


def hashed(at: np.ndarray, words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words given as numbers."""
    return np.array([xxhash.xxh3_64_intdigest(w) for w in words] or [0], np.uint64)[at]


def deal(docs: DataFrame, chars: int, per_block: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """`block`, `doc_id`, text `t`, name (`k1`, `k2`) and number of `copies` of all different
    rows, and, if any row comes repeatedly, the names of all rows (else None).

    The block hangs on id and text alone, so a row sent again and again has to be one row
    of its block. Only if there are such rows the texts are brought together for it,
    combined before they cross the network.
    """
    blocks = parts_of(docs.sparkSession, chars, per_block or BLOCK_CHARS)
    k1, k2 = F.xxhash64("doc_id", "text"), F.xxhash64(F.lit(1), "text", "doc_id")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    repeated = not rows.groupBy(k1).agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    if repeated:
        held = stored(rows.groupBy("doc_id", "text").agg(F.count("*").alias("copies")))
    else:
        held = rows.withColumn("copies", F.lit(1).cast("long"))
    dealt = held.select(
        F.pmod(k1, F.lit(blocks).cast("long")).alias("block"), "doc_id", k1.alias("k1"), k2.alias("k2"),
        F.coalesce("text", F.lit("")).alias("t"), "copies")
    return dealt, rows.select(k1.alias("k1"), k2.alias("k2")) if repeated else None


def for_all(done: DataFrame, names: DataFrame | None) -> DataFrame:
    """What came out for different rows, once for each row: `names` as deal() gives them."""
    return done if names is None else spread_join(names, done, ["k1", "k2"])


def parts_for(docs: DataFrame, chars: int) -> int:
    return parts_of(docs.sparkSession, chars, PART_CHARS)


def _width(parts: int) -> int:
    """Part p holds the hashes from p times this number, so order by hash is order by part."""
    return (2**64 - 1) // parts


def _distinct(k1: np.ndarray, k2: np.ndarray | None, parts: int):
    """Order of keys by (part, k1, k2), where a new key opens, and where each part does."""
    order = np.argsort(k1) if k2 is None else np.lexsort((k2, k1))
    a = k1[order]
    new = np.ones(len(a), bool)
    new[1:] = a[1:] != a[:-1]
    if k2 is not None:
        b = k2[order]
        new[1:] |= b[1:] != b[:-1]
    lows = np.arange(parts, dtype=np.uint64) * np.uint64(_width(parts))
    return order, new, np.append(np.searchsorted(a[new], lows), int(new.sum()))


def _pack(counts: np.ndarray) -> bytes:
    """Counts as one byte each, those of 255 and more written out behind."""
    low = zlib.compress(np.minimum(counts, 255).astype(np.uint8).tobytes(), 1)
    return len(low).to_bytes(4, "little") + low + zlib.compress(counts[counts >= 255].astype("<i8").tobytes(), 1)


def _unpack(data: bytes) -> np.ndarray:
    end = 4 + int.from_bytes(data[:4], "little")
    counts = np.frombuffer(zlib.decompress(data[4:end]), np.uint8).astype(np.int64)
    counts[counts == 255] = np.frombuffer(zlib.decompress(data[end:]), "<i8")
    return counts


def _pack_keys(keys: np.ndarray, low: int) -> bytes:
    """Rising 64-bit hashes from `low` on as steps, byte by byte: the three high bytes of
    the steps of many hashes are small numbers and compress, the others do not."""
    steps = np.diff(keys, prepend=np.uint64(low)).astype("<u8").view(np.uint8).reshape(-1, 8).T
    squeeze = zlib.compressobj(1, zlib.DEFLATED, 15, 8, zlib.Z_HUFFMAN_ONLY)
    high = squeeze.compress(steps[5:].tobytes()) + squeeze.flush()
    return np.array([len(high), low], "<u8").tobytes() + high + steps[:5].tobytes()


def _unpack_keys(data: bytes) -> np.ndarray:
    size, low = np.frombuffer(data[:16], "<u8")
    end = 16 + int(size)
    planes = np.frombuffer(data[end:] + zlib.decompress(data[16:end]), np.uint8).reshape(8, -1)
    return low + np.cumsum(np.ascontiguousarray(planes.T).view("<u8").reshape(-1), dtype=np.uint64)


def ask_rows(block: int, keys: dict, parts: int) -> pa.Table:
    """The asks of one block. `keys` has for each kind (k1, k2 or None, weights or None)."""
    columns = [[] for _ in range(6)]
    for kind, (k1, k2, weight) in keys.items():
        order, new, at = _distinct(k1, k2, parts)
        first = np.flatnonzero(new)
        n = np.add.reduceat((np.ones(len(k1), np.int64) if weight is None else weight)[order], first) if len(first) else np.zeros(0, np.int64)
        a, b = k1[order][first], None if k2 is None else k2[order][first]
        for p in np.flatnonzero(at[1:] > at[:-1]).tolist():
            cut = slice(at[p], at[p + 1])
            for column, value in zip(columns, (p, block, kind, _pack_keys(a[cut], p * _width(parts)), b[cut].tobytes() if b is not None else None, _pack(n[cut]))):
                column.append(value)
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["part", "block", "kind", "k1", "k2", "n"])


def asks(texts: DataFrame, keys_of, parts: int) -> DataFrame:
    """Asks of all blocks; `keys_of(table)` makes the keys of one block's texts."""
    def run(table: pa.Table) -> pa.Table:
        return ask_rows(table.column("block")[0].as_py(), keys_of(table), parts)

    return texts.groupBy("block").applyInArrow(run, _ASK)


def totals(asked: DataFrame, most: int | None = None) -> DataFrame:
    """Answers to all asks; totals above `most` are told as `most`."""
    def run(table: pa.Table) -> pa.Table:
        out = [None] * table.num_rows
        kinds = table.column("kind").to_numpy()
        for kind in np.unique(kinds):
            rows = np.flatnonzero(kinds == kind).tolist()
            k1 = [_unpack_keys(table.column("k1")[i].as_py()) for i in rows]
            packed = [table.column("k2")[i].as_py() for i in rows]
            k2 = None if packed[0] is None else np.concatenate([np.frombuffer(p, "<u8") for p in packed])
            n = np.concatenate([_unpack(table.column("n")[i].as_py()) for i in rows])
            order, new, _ = _distinct(np.concatenate(k1), k2, 1)
            sums = np.add.reduceat(n[order], np.flatnonzero(new))
            mine = np.empty(len(n), np.int64)
            mine[order] = sums[np.cumsum(new) - 1]
            mine = mine if most is None else np.minimum(mine, most)
            end = 0
            for i, k in zip(rows, k1):
                out[i] = _pack(mine[end:end + len(k)])
                end += len(k)
        return pa.Table.from_arrays(
            [table.column("block"), table.column("part"), table.column("kind"), pa.array(out, pa.binary())],
            ["block", "part", "kind", "n"])

    return asked.groupBy("part").applyInArrow(run, _TOLD)


def told(answers: pa.Table, kind: int, k1: np.ndarray, k2: np.ndarray | None, parts: int) -> np.ndarray:
    """Total of every key of a block, from the answers to its asks of that kind."""
    order, new, at = _distinct(k1, k2, parts)
    known = np.zeros(int(at[-1]), np.int64)
    for p, k, n in zip(*(answers.column(c).to_pylist() for c in ("part", "kind", "n"))):
        if k == kind:
            known[at[p]:at[p + 1]] = _unpack(n)
    out = np.empty(len(k1), np.int64)
    if len(k1):
        out[order] = known[np.cumsum(new) - 1]
    return out


def with_answers(texts: DataFrame, answers: DataFrame, run, schema: str) -> DataFrame:
    """`run(texts table, answers table)` for every block."""
    def both(left: pa.Table, right: pa.Table) -> pa.Table:
        return run(left, right)

    return texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(both, schema)
