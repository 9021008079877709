"""Line de-duplication over range-partitioned line hashes.

Only hashes move: (hash, document, positions) rows are dealt by ranges of (hash, document
falling) and sorted so within each part. A task reads its part as a stream; the first row
of a hash is its largest document, so it decides with a handful of rows in memory. A hash
whose rows reach into the next part is settled from one summary row for each end of each
part. What comes back for a document is a compressed bitmap of the lines to keep.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentrymill.llm.common import parts_of, stored, text_bytes

LEAST_CHARS = 40     # code points of a line that counts
LEAST_DOCS = 5       # documents that must hold it
ROWS_PER_PART = 2_000_000

_HELD = "h1 long, h2 long, doc_id long, sub long, at binary"
_FOUND = "kind int, h1 long, h2 long, doc_id long, sub long, at binary, n long"


def line_key(line: bytes) -> bytes:
    return line.strip().lower()


def _counts(key: bytes, least: int) -> bool:
    return len(key) >= 4 * least or len(key) >= least and len(key.decode("utf-8", "replace")) >= least


def line_hashes(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """One row for each key and row of `docs` that holds it: 128-bit hash, `doc_id`,
    `sub` (hash of the text, which tells rows with one doc_id apart) and its positions."""
    def run(batches):
        for batch in batches:
            out = [[], [], [], [], []]
            for doc, sub, text in zip(*(c.to_pylist() for c in batch.columns)):
                held: dict[bytes, list[int]] = {}
                for at, line in enumerate(text.split(b"\n")):
                    key = line_key(line)
                    if _counts(key, least_chars):
                        held.setdefault(xxhash.xxh3_128_digest(key), []).append(at)
                for digest, at in held.items():
                    out[0].append(int.from_bytes(digest[:8], "big", signed=True))
                    out[1].append(int.from_bytes(digest[8:], "big", signed=True))
                    out[2].append(doc)
                    out[3].append(sub)
                    out[4].append(np.array(at, np.int32).tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in out[:4]] + [pa.array(out[4], pa.binary())],
                ["h1", "h2", "doc_id", "sub", "at"])

    return docs.where("doc_id is not null").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("sub"), text_bytes().alias("t")
    ).mapInArrow(run, _HELD)


def _stream(least_docs: int):
    """Decisions of one sorted part. Kind 0: drop these lines. Kind 1: how many documents
    of a hash at an end of the part, and the first of them. Kind 2: a row that hangs on
    other parts."""
    def run(batches):
        first, now, held, docs, top, last = True, None, [], 0, None, None
        for batch in batches:
            out = []
            for h1, h2, doc, sub, at in zip(*(c.to_pylist() for c in batch.columns)):
                if (h1, h2) != now:
                    if first and now is not None:
                        out.append((1, *now, top, None, None, docs))
                    first = now is None
                    now, held, docs, top, last = (h1, h2), [], 0, doc, None
                if doc != last:
                    docs, last = docs + 1, doc
                if first:                       # may go on from the part before
                    out.append((2, h1, h2, doc, sub, at, None))
                elif docs < least_docs:
                    if doc != top:
                        held.append((doc, sub, at))
                else:
                    out += [(0, h1, h2, *row, None) for row in held]
                    held = []
                    if doc != top:
                        out.append((0, h1, h2, doc, sub, at, None))
            yield _batch(out)
        if now is not None:                     # may go on in the next part
            out = [(1, *now, top, None, None, docs)]
            out += [(2, *now, *row, None) for row in held]
            yield _batch(out)

    def _batch(rows):
        columns = list(zip(*rows)) or [[]] * 7
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64()]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds)], ["kind", "h1", "h2", "doc_id", "sub", "at", "n"])

    return run


def keep_bitmaps(
    docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS
) -> DataFrame:
    """`doc_id`, `sub` and `keep` of the documents that lose a line: a zlib-compressed
    bitmap with one bit for each line up to the last that goes; later lines all stay.

    Keys of at least `least_chars` code points found in at least `least_docs` different
    doc_ids lose all their lines except in the largest doc_id. Rows with null doc_id hold
    and lose nothing. Starts jobs when called; hashes and decisions are kept in the
    shared folder, texts never.
    """
    rows = stored(line_hashes(docs, least_chars))
    parts = parts_of(docs.sparkSession, rows.count(), ROWS_PER_PART)
    order = [F.col("h1"), F.col("h2"), F.col("doc_id").desc()]
    found = stored(
        rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(_stream(least_docs), _FOUND)
    )
    # at most two rows for each part: safe to send to all tasks
    ends = found.where("kind = 1").groupBy("h1", "h2").agg(
        F.sum("n").alias("docs"), F.max("doc_id").alias("top"))
    hanging = found.where("kind = 2").drop("n").join(F.broadcast(ends), ["h1", "h2"]).where(
        f"docs >= {least_docs} and doc_id <> top")
    drops = found.where("kind = 0").select("doc_id", "sub", "at").unionByName(
        hanging.select("doc_id", "sub", "at"))

    @F.pandas_udf("binary")
    def bitmap(lists: pd.Series) -> pd.Series:
        def one(parts):
            at = np.concatenate([np.frombuffer(p, np.int32) for p in parts])
            keep = np.ones((at.max() // 8 + 1) * 8, bool)     # whole bytes; the rest stays
            keep[at] = False
            return zlib.compress(np.packbits(keep, bitorder="little").tobytes())
        return lists.map(one)

    return drops.groupBy("doc_id", "sub").agg(F.collect_list("at").alias("_at")).select(
        "doc_id", "sub", bitmap("_at").alias("keep"))


def kept_lines(text: bytes, keep: bytes | None) -> tuple[bytes, int, int]:
    """The text that is left, its lines before and the lines dropped."""
    lines = text.split(b"\n")
    if keep is None:
        return text, len(lines), 0
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), bitorder="little")
    gone = set(np.flatnonzero(bits == 0).tolist())
    kept = [line for at, line in enumerate(lines) if at not in gone]
    return b"\n".join(kept), len(lines), len(lines) - len(kept)


def dedup_lines(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """`docs` with `text` reduced to the lines that stay, and `_n_lines`, `_n_dropped`.

    One row per input row, other columns as they are. A null or empty text is one empty
    line; it comes out as an empty text. Rows repeated with one doc_id and text lose the
    same lines; with another text each loses its own.
    """
    marks = keep_bitmaps(docs, least_chars, least_docs).select(
        F.col("doc_id").alias("_doc"), F.col("sub").alias("_sub"), F.col("keep").alias("_keep"))

    @F.pandas_udf("text string, n long, dropped long")
    def cut(texts: pd.Series, keeps: pd.Series) -> pd.DataFrame:
        rows = [kept_lines(t, k) for t, k in zip(texts, keeps)]
        return pd.DataFrame({"text": [r[0].decode("utf-8", "replace") for r in rows],
                             "n": [r[1] for r in rows], "dropped": [r[2] for r in rows]})

    joined = docs.join(
        marks, (F.col("doc_id").cast("long") == F.col("_doc")) & (F.xxhash64("text") == F.col("_sub")), "left")
    return joined.withColumn("_cut", cut(text_bytes(), F.col("_keep"))).select(
        *[F.col("_cut.text").alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns],
        F.col("_cut.n").alias("_n_lines"), F.col("_cut.dropped").alias("_n_dropped"),
    )
