"""Benchmark decontamination by template windows.

Numbers, names and units become typed placeholders, so a question comes out alike
whatever values it is asked with. Windows of template tokens are hash-joined with those
of the benchmark; where they meet, each value of the item must stand for one value of the
text along the passage, else the windows do not count. A template window needs enough
plain words: one that is mostly placeholders would meet any table of numbers or list of
names. Windows of the plain words are joined as well, which finds such passages where they
are repeated word by word, and a passage whose capitals were changed.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentrymill.llm.blocks import word_codes
from sentrymill.llm.common import Memo, spread_join, stored, texts_or_empty
from sentrymill.llm.quality import _pieces

WINDOW = 8            # template tokens; an item with fewer is one window
LEAST_SHARE = 0.5     # of an item's tokens that must lie in windows found, or
VERBATIM = 13         # tokens of an item in a row, found word by word
LEAST_PLAIN = 4       # plain tokens of a template window (or all it has), and half of it
SENT_HASHES = 1_000_000   # most benchmark windows that are sent to all tasks as a filter
EDGE = ".,;:!?\"'()[]{}<>%$#&*|`~-_=+/\\^"
ENDS = (".", "!", "?", ":")
# Units of measure, as fixed values.
UNITS = frozenset(
    "mm cm m km inch inches foot feet yard yards mile miles mg g kg ton tons lb lbs oz ml l litre "
    "litres liter liters gallon gallons s sec second seconds min minute minutes h hour hours day "
    "days week weeks month months year years percent dollar dollars euro euros cent cents pound "
    "pounds degree degrees mph kph kmh watt watts volt volts".split()
)
# A number: digits with separators, a sign before or a short unit after; `w12` is none.
NUMBER = re.compile(r"[+-]?\d[\d.,:/'-]*(?:[eE][+-]?\d+)?[^\W\d_]{0,3}")
_PLAIN, _TEMPLATE = 0, 1
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_ROW = "h long, id long, sub long, pos int, slots array<bigint>"


def mix(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    """A 64-bit hash of two 64-bit values in order."""
    with np.errstate(over="ignore"):
        x = (a * np.uint64(0xBF58476D1CE4E5B9)) ^ (b + _GOLD + (a << np.uint64(6)) + (a >> np.uint64(2)))
        x ^= x >> np.uint64(31)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(29)
        x *= _GOLD
        return x ^ (x >> np.uint64(32))


def window_hashes(tokens: np.ndarray, width: int) -> np.ndarray:
    """Hash of every `width` tokens in a row, by doubling."""
    out, covered, power, span = None, 0, tokens, 1
    while True:
        if width & span:
            out = power if out is None else mix(out[: len(tokens) - width + 1], power[covered: covered + len(tokens) - width + 1])
            covered += span
        if covered == width:
            return out[: max(0, len(tokens) - width + 1)]
        power = mix(power[:-span], power[span:])
        span *= 2


def _classes(word: bytes) -> tuple[int, str, bool]:
    """Class of a word (0 word, 1 number, 2 capitalised, 3 unit), its lower-case core,
    and whether it ends a sentence."""
    text = word.decode("utf-8", "replace")
    core = text.strip(EDGE)
    kind = 1 if NUMBER.fullmatch(core) else 3 if core.lower() in UNITS else 2 if core[:1].isupper() and not core.isupper() else 0
    return kind, core.lower(), text.rstrip("\"')]}").endswith(ENDS)


def _classed(word: bytes) -> tuple[int, int]:
    """Hash of a word's core, and its class, whether it ends a sentence and has a core."""
    kind, core, ends = _classes(word)
    return xxhash.xxh64_intdigest(core.encode()), kind | ends << 2 | bool(core) << 3


def _tokens(texts: pa.Array, classes: Memo):
    """Plain tokens, template tokens, slot flags and text numbers of all words with a core.
    `classes` remembers words met before."""
    at, words, counts = word_codes(texts)
    known = [classes[w] for w in words] or [(0, 0)]
    doc = np.repeat(np.arange(len(counts)), counts)
    plain = np.array([h for h, _ in known], np.uint64)[at]
    flags = np.array([f for _, f in known])[at]
    kind, ends, full = flags & 3, (flags & 4) > 0, (flags & 8) > 0
    if len(at):
        opens = np.ones(len(at), bool)
        opens[1:] = (doc[1:] != doc[:-1]) | ends[:-1]
        after_number = np.zeros(len(at), bool)
        after_number[1:] = (kind[:-1] == 1) & (doc[1:] == doc[:-1])
        slot = (kind == 1) | (kind == 2) & ~opens | (kind == 3) & after_number
    else:
        slot = np.zeros(0, bool)
    template = np.where(slot, kind.astype(np.uint64), plain)
    return plain[full], template[full], slot[full], doc[full]


def least_plain(width: int) -> int:
    """Plain tokens that a template window of this width must have."""
    return max(-(-width // 2), min(LEAST_PLAIN, width))


def _windows(rows: DataFrame, widths: list[int] | None, known: np.ndarray | None) -> DataFrame:
    """(`h`, `id`, `sub`, `pos`, `slots`) for windows of each text (columns id, sub, t) in
    both forms; a template window has a slot and enough plain tokens, else its plain form says
    all. `widths` None: one width for each text, WINDOW or its length if shorter (the
    benchmark's side). `known` (sorted hashes) leaves out windows that can meet nothing."""
    def run(batches):
        classes = Memo(_classed)
        for batch in _pieces(batches):
            ids, subs = batch.column(0), batch.column(2)
            plain, template, slot, doc = _tokens(batch.column(1), classes)
            lengths = np.bincount(doc, minlength=batch.num_rows) if len(doc) else np.zeros(batch.num_rows, int)
            slots_before = np.concatenate([[0], np.cumsum(slot)])
            found = []
            for width in widths or sorted({min(WINDOW, n) for n in lengths.tolist() if n}):
                if len(doc) < width:
                    continue
                whole = doc[: len(doc) - width + 1] == doc[width - 1:]
                if widths is None:
                    whole &= np.minimum(lengths, WINDOW)[doc[: len(whole)]] == width
                slots = slots_before[width:] - slots_before[:-width]
                mixed = whole & (slots > 0) & (width - slots >= least_plain(width))
                for form, tokens, fits in ((_PLAIN, plain, whole), (_TEMPLATE, template, mixed)):
                    h = mix(window_hashes(tokens, width), np.uint64(form * 64 + width)).view(np.int64)
                    take = fits
                    if known is not None:
                        near = np.minimum(np.searchsorted(known, h), max(len(known) - 1, 0))
                        take = fits & (known[near] == h) if len(known) else np.zeros_like(fits)
                    found.append((np.flatnonzero(take), h[take], form, width))
            starts = np.concatenate([[0], np.cumsum(lengths)])
            signed = plain.view(np.int64)
            for at, h, form, width in found:
                for some in range(0, len(at), 20_000):
                    a = at[some:some + 20_000]
                    slots = [signed[p:p + width][slot[p:p + width]].tolist() for p in a.tolist()] if form == _TEMPLATE else [[]] * len(a)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(h[some:some + 20_000]), ids.take(pa.array(doc[a])), subs.take(pa.array(doc[a])),
                         pa.array((a - starts[doc[a]]).astype(np.int32)), pa.array(slots, pa.list_(pa.int64()))],
                        ["h", "id", "sub", "pos", "slots"])

    return rows.mapInArrow(run, _ROW)


def _widths(items: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            *_, doc = _tokens(batch.column(1), Memo(_classed))
            n = np.bincount(doc, minlength=batch.num_rows) if len(doc) else np.zeros(batch.num_rows, int)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n.astype(np.int64))], ["item_id", "tokens"])

    return items.mapInArrow(run, "item_id long, tokens long")


def agreeing(windows: list) -> tuple[set[int], set[int], bool]:
    """Of one passage: item positions of the windows that count, those of them that are
    word by word, and whether a slot was changed.

    `windows` are (item position, item slots, text slots), without slots where the plain
    words are alike. In a passage, windows with one distance between the two positions, a
    slot value of the item must stand for one value of the text; the most frequent pairing
    rules and windows against it do not count.
    """
    votes = Counter(p for _, mine, theirs in {(b, tuple(m), tuple(t)) for b, m, t in windows} for p in zip(mine, theirs))
    there = {}
    for (x, y), _ in sorted(votes.items(), key=lambda v: (-v[1], v[0])):
        there.setdefault(x, y)
    good, verbatim, changed = set(), set(), False
    for b, mine, theirs in windows:
        if all(there[x] == y for x, y in zip(mine, theirs)):
            good.add(b)
            changed |= list(mine) != list(theirs)
            if not mine:
                verbatim.add(b)
    return good, verbatim, changed


def longest_run(positions: set[int], width: int) -> int:
    """Tokens of the longest unbroken stretch of windows."""
    best = run = 0
    for b in sorted(positions):
        run = run + 1 if b - 1 in positions else 1
        best = max(best, run)
    return best + width - 1 if best else 0


def _words(tokens: set[int]) -> dict[int, int]:
    """Positions as signed 64-bit words with their number."""
    words: dict[int, int] = {}
    for t in tokens:
        words[t >> 6] = words.get(t >> 6, 0) | 1 << (t & 63)
    return {k: v - (1 << 64) if v >> 63 else v for k, v in words.items()}


_JUDGED = "id long, sub long, item_id long, word int, cover long, starts long, run int, changed boolean"


def _found(docs: DataFrame, items: DataFrame, least_share: float, verbatim: int) -> DataFrame:
    """One row for each row of `docs` (doc_id, hash of the text) and item found in it."""
    sides = items.select(
        F.col("item_id").cast("long").alias("item_id"), texts_or_empty().alias("t"), F.lit(0).cast("long").alias("sub"))
    lengths = stored(_widths(sides).groupBy("item_id").agg(F.max("tokens").alias("tokens")))
    # an item that comes several times counts once
    bench = stored(_windows(sides, None, None).distinct())
    widths = [r[0] for r in lengths.where("tokens > 0").select(
        F.least(F.col("tokens"), F.lit(WINDOW)).alias("w")).distinct().orderBy("w").collect()]   # WINDOW at most
    hashes = bench.select("h").distinct().limit(SENT_HASHES + 1).collect()
    known = np.sort(np.array([r[0] for r in hashes], np.int64)) if len(hashes) <= SENT_HASHES else None
    texts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), texts_or_empty().alias("t"), F.xxhash64("text").alias("sub"))
    mine = bench.select("h", F.col("id").alias("item_id"), F.col("pos").alias("b"), F.col("slots").alias("b_slots"))
    theirs = _windows(texts, widths or [WINDOW], known).withColumnsRenamed({"pos": "d", "slots": "d_slots"})
    if known is None:     # Spark sizes the windows by the documents, of which each makes hundreds: no broadcast
        theirs = theirs.hint("merge")
    # a passage is bounded by its item, however often a text repeats itself
    passages = spread_join(theirs, mine, ["h"]).withColumn("distance", F.col("d") - F.col("b")).groupBy(
        "id", "sub", "item_id", "distance").agg(F.collect_set(F.struct("b", "b_slots", "d_slots")).alias("windows"))
    with_tokens = passages.withColumnRenamed("item_id", "_item").join(
        lengths.hint("rebalance"), F.col("_item").eqNullSafe(F.col("item_id"))).select("id", "sub", "item_id", "windows", "tokens")

    def judge(batches):
        for batch in batches:
            out = [[] for _ in range(8)]
            for doc, sub, item, windows, tokens in zip(*(c.to_pylist() for c in batch.columns)):
                width = min(tokens, WINDOW)
                good, plain, changed = agreeing([(w["b"], w["b_slots"], w["d_slots"]) for w in windows])
                cover, starts = _words({b + i for b in good for i in range(width)}), _words(good)
                run = longest_run(plain, width)
                for word, bits in cover.items():
                    for column, value in zip(out, (doc, sub, item, word, bits, starts.get(word, 0), run, changed)):
                        column.append(value)
            kinds = [pa.int64()] * 3 + [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.bool_()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(out, kinds)], [f.split()[0] for f in _JUDGED.split(", ")])

    judged = with_tokens.mapInArrow(judge, _JUDGED)
    both = judged.groupBy("id", "sub", "item_id", "word").agg(
        F.bit_or("cover").alias("cover"), F.bit_or("starts").alias("starts"), F.max("run").alias("run"),
        F.max("changed").alias("changed"),
    ).groupBy("id", "sub", "item_id").agg(
        F.sum(F.bit_count("cover")).alias("covered"), F.sum(F.bit_count("starts")).cast("long").alias("n_windows"),
        F.max("run").cast("long").alias("verbatim"), F.max("changed").alias("reparameterised"))
    return both.withColumnRenamed("item_id", "_item").join(
        lengths.hint("rebalance"), F.col("_item").eqNullSafe(F.col("item_id"))
    ).withColumn("share", F.col("covered") / F.col("tokens")).where(
        (F.col("share") >= least_share) | (F.col("verbatim") >= verbatim)
    ).select(F.col("id").alias("doc_id"), "sub", "item_id", "n_windows", "share", "verbatim", "reparameterised")


def contaminated(
    docs: DataFrame, items: DataFrame, least_share: float = LEAST_SHARE, verbatim: int = VERBATIM
) -> DataFrame:
    """One row for each document and benchmark item found in it: `doc_id`, `item_id`,
    `n_windows` (item positions found), `share` of the item's tokens they cover, `verbatim`
    (the most tokens in a row that are there word by word), `reparameterised` (a slot has
    another value than the item's).

    Listed are pairs whose share is at least `least_share`, and those with `verbatim` tokens
    in a row whatever their share. Null and empty texts on either side meet nothing; rows
    with null ids are kept with a null id; of documents with one doc_id the text with the
    largest share counts, and repeated items count as one. Extra columns are ignored. If the
    benchmark has at most SENT_HASHES windows their hashes are sent to the tasks, which
    then emit only windows that can meet; beyond it all windows are shuffled to the same
    join. Starts small jobs on the benchmark when called.
    """
    rest = ["n_windows", "share", "verbatim", "reparameterised"]
    best = F.max(F.struct("share", "verbatim", "n_windows", "reparameterised", "sub")).alias("_b")
    return _found(docs, items, least_share, verbatim).groupBy("doc_id", "item_id").agg(best).select(
        "doc_id", "item_id", *[f"_b.{c}" for c in rest])


def drop_contaminated(
    docs: DataFrame, items: DataFrame, least_share: float = LEAST_SHARE, verbatim: int = VERBATIM
) -> DataFrame:
    """`docs` without the rows that hold a benchmark item. A row is judged by its own text, also
    where its doc_id is null or comes with other texts too."""
    bad = _found(docs, items, least_share, verbatim).select(
        F.col("doc_id").alias("_bad"), F.col("sub").alias("_bad_text")).distinct()
    return docs.join(bad.hint("rebalance"), F.col("doc_id").cast("long").eqNullSafe(F.col("_bad"))
                     & (F.xxhash64("text") == F.col("_bad_text")), "left_anti")
