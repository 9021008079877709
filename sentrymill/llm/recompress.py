"""Removal of long repeated passages by recompression.

Rounds name runs of equal tokens and pairs of neighbours. A name is a hash of what it
stands for, so every task in the cluster gives one content one name, and which of two
symbols may open a pair is a bit of its name. So equal passages get equal symbols inside,
whatever stands around them; only near their ends may the outside interfere. Each symbol
carries the range of words that settles it. A window of WINDOW words holds some symbols
that it settles alone; the longest, then the one with the least hash, is its anchor. Equal windows have
equal anchors, so only windows whose anchor turns up twice can repeat, and those alone
are compared, by a 128-bit hash of their words. Both counts are taken over the whole
corpus block by block (see blocks.py).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from sentrymill.llm import blocks
from sentrymill.llm.benchmark import mix, window_hashes
from sentrymill.llm.common import total_chars

WINDOW = 35     # words
ROUNDS = 4      # of pair naming; symbols then stand for about three words
_PIECE = 1 << 17   # words worked on at a time
_MAX = np.uint64(0xFFFFFFFFFFFFFFFF)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of `texts` in order, and how many each text has."""
    at, words, counts = blocks.word_codes(texts)
    return blocks.hashed(at, words), counts


def symbols(words: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS):
    """Symbols after `rounds`: name, number of words, the words that settle it (`lo` to
    `hi`, end excluded), and whether it is settled inside its text whatever comes before
    or after."""
    name, doc = words, np.repeat(np.arange(len(counts)), counts)
    long = np.ones(len(words), np.int64)
    lo = np.arange(len(words), dtype=np.int64)
    hi, free = lo + 1, np.ones(len(words), bool)

    def widen(first, last, left, right):
        """Ranges of symbols `first` to `last` that also need the neighbour on a side."""
        n = len(doc)
        has_left = (first > 0) & (doc[np.maximum(first - 1, 0)] == doc[first])
        has_right = (last < n - 1) & (doc[np.minimum(last + 1, n - 1)] == doc[last])
        low = np.where(left & has_left, lo[np.maximum(first - 1, 0)], lo[first])
        high = np.where(right & has_right, hi[np.minimum(last + 1, n - 1)], hi[last])
        sure = free[first] & free[last] & ~(left & ~has_left) & ~(right & ~has_right)
        sure &= np.where(left & has_left, free[np.maximum(first - 1, 0)], True)
        sure &= np.where(right & has_right, free[np.minimum(last + 1, n - 1)], True)
        return low, high, sure

    for level in range(rounds):
        if not len(name):
            break
        if level == 0:   # runs of one word; later rounds find no gain in them
            first = np.flatnonzero(np.concatenate([[True], (name[1:] != name[:-1]) | (doc[1:] != doc[:-1])]))
            last = np.concatenate([first[1:], [len(name)]]) - 1
            size = (last - first + 1).astype(np.uint64)
            both = np.ones(len(first), bool)
            lo2, hi2, free2 = widen(first, last, both, both)
            name = np.where(size > 1, mix(name[first], size), name[first])
            doc, lo, hi, free, long = doc[first], lo2, hi2, free2, last - first + 1
        opens = (mix(name, np.uint64(level + 101)) >> np.uint64(63)) == 0
        pair = np.zeros(len(name), bool)
        pair[:-1] = opens[:-1] & ~opens[1:] & (doc[1:] == doc[:-1])
        second = np.concatenate([[False], pair[:-1]])
        first = np.flatnonzero(~second)
        joined = pair[first]
        last = first + joined
        lo2, hi2, free2 = widen(first, last, ~joined & ~opens[first], ~joined & opens[first])
        name = np.where(joined, mix(mix(name[first], np.uint64(level + 7)), name[last]), name[first])
        long = np.add.reduceat(long, first)
        doc, lo, hi, free = doc[first], lo2, hi2, free2
    return name, long, lo, hi, free


def anchors(words: np.ndarray, counts: np.ndarray, width: int = WINDOW, rounds: int = ROUNDS):
    """Stretches of window starts that share an anchor: anchor, text, first and last start
    (counted in the text), and whether equal windows already meet inside the stretch."""
    name, long, lo, hi, free = symbols(words, counts, rounds)
    begin = np.cumsum(counts) - counts
    doc = np.repeat(np.arange(len(counts)), counts)
    start = np.flatnonzero(np.arange(len(words)) + width <= (begin + counts)[doc]) if len(words) else np.zeros(0, np.int64)
    if not len(start):
        return (np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3, np.zeros(0, bool))
    free = free & (hi - lo <= width)
    # the symbol of most words comes first: it is the least likely to turn up by chance
    rank = (mix(name, np.uint64(11)) >> np.uint64(8)) | ((width + 1 - np.minimum(long, width)).astype(np.uint64) << np.uint64(56))
    order = np.where(free, rank, _MAX)
    # a window's own symbols lie side by side: ranges only widen from left to right
    left = np.searchsorted(lo, start, "left")
    right = np.searchsorted(hi, start + width, "right") - 1
    best = np.full(len(start), -1, np.int64)
    span = right - left + 1
    table, step = np.arange(len(name)), 1
    while True:
        now = (span >= step) & (span < 2 * step)
        if now.any():
            a, b = table[left[now]], table[right[now] - step + 1]
            best[now] = np.where(order[a] <= order[b], a, b)
        if 2 * step > span.max():
            break
        a, b = table[:-step], table[step:]
        table, step = np.concatenate([np.where(order[a] <= order[b], a, b), table[len(table) - step:]]), 2 * step
    none = (best < 0) | (order[np.maximum(best, 0)] == _MAX)
    whole = window_hashes(words, width)[start]     # for windows that settle no symbol
    key = np.where(none, mix(whole, np.uint64(3)), name[np.maximum(best, 0)])
    place = np.where(none, -1, best)
    new = np.concatenate([[True], (key[1:] != key[:-1]) | (place[1:] != place[:-1]) | (start[1:] != start[:-1] + 1) | (doc[start[1:]] != doc[start[:-1]])])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(start)]]) - 1
    text = doc[start[first]]
    return key[first], text, start[first] - begin[text], start[last] - begin[text], none[first] & (last > first)


def _stretches(words: np.ndarray, counts: np.ndarray, width: int, rounds: int):
    """anchors() for many texts, worked on in pieces that stay small."""
    ends = np.cumsum(counts)
    cuts = (np.flatnonzero(np.diff(ends // _PIECE)) + 1).tolist() if len(ends) else []
    parts = []
    for a, b in zip([0, *cuts], [*cuts, len(counts)]):
        if b > a:
            low = ends[a - 1] if a else 0
            key, text, first, last, sure = anchors(words[low:ends[b - 1]], counts[a:b], width, rounds)
            parts.append((key, text + a, first, last, sure))
    return [np.concatenate(p) for p in zip(*parts)] if parts else anchors(words, counts, width, rounds)


def _windows(words, counts, text, first, last, width):
    """128-bit hashes of all windows of some stretches, with text and start of each."""
    sizes = last - first + 1
    text = np.repeat(text, sizes)
    start = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(first, sizes)
    raw, step = memoryview(words.tobytes()), 8 * width
    at = (8 * ((np.cumsum(counts) - counts)[text] + start)).tolist() if len(text) else []
    digest = xxhash.xxh3_128_digest
    keys = np.frombuffer(b"".join([digest(raw[a:a + step]) for a in at]), "<u8").reshape(-1, 2)
    return np.ascontiguousarray(keys[:, 0]), np.ascontiguousarray(keys[:, 1]), text, start


def remove_repeats(docs: DataFrame, width: int = WINDOW, rounds: int = ROUNDS, texts: bool = True) -> DataFrame:
    """One row per input row: `doc_id`, `n_words`, `n_removed`, `kept_sha256` and, if
    asked for, `kept` (the words left, joined by one space).

    A word goes if a window of `width` consecutive words covers it whose word sequence
    also starts anywhere else in the input. Null and empty texts have no words. Rows
    repeated with one doc_id and text repeat each other and lose alike; a block holds one
    of them with their number. A null doc_id is kept as null. Extra columns are ignored.
    When called it starts jobs that count the characters and look for repeated rows.
    """
    chars = total_chars(docs)
    parts = blocks.parts_for(docs, chars)
    dealt, names = blocks.deal(docs, chars)

    def stretches(table):
        words, counts = word_hashes(table.column("t"))
        return words, counts, _stretches(words, counts, width, rounds)

    def anchor_keys(table):
        _, _, (key, text, _, _, sure) = stretches(table)
        return {0: (key, None, (1 + sure.astype(np.int64)) * table.column("copies").to_numpy()[text])}

    def candidates(table, answers):
        words, counts, (key, text, first, last, _) = stretches(table)
        twice = blocks.told(answers, 0, key, None, parts) > 1
        return words, counts, _windows(words, counts, text[twice], first[twice], last[twice], width)

    def ask_windows(table, answers):
        if not table.num_rows:
            return blocks.ask_rows(0, {}, parts)
        _, _, (k1, k2, text, _) = candidates(table, answers)
        return blocks.ask_rows(
            table.column("block")[0].as_py(), {1: (k1, k2, table.column("copies").to_numpy()[text])}, parts)

    def cut(table, answers):
        _, counts, (k1, k2, text, start) = candidates(table, answers)
        twice = blocks.told(answers, 1, k1, k2, parts) > 1
        begin = np.cumsum(counts) - counts
        edge = np.zeros(int(counts.sum()) + 1, np.int64)
        at = begin[text[twice]] + start[twice]
        np.add.at(edge, at, 1)
        np.add.at(edge, at + width, -1)
        gone = np.cumsum(edge)[:-1] > 0
        out = [[], [], [], []]
        for body, low, n in zip(table.column("t").to_pylist(), begin.tolist(), counts.tolist()):
            words = body.encode().split()
            mine = gone[low:low + n]
            left = b" ".join([words[i] for i in np.flatnonzero(~mine).tolist()] if mine.any() else words)
            for column, value in zip(out, (n, int(mine.sum()), hashlib.sha256(left).hexdigest(), left.decode() if texts else None)):
                column.append(value)
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string()]
        return pa.Table.from_arrays(
            [*(table.column(c) for c in ("k1", "k2", "doc_id")), *[pa.array(c, k) for c, k in zip(out, kinds)]],
            ["k1", "k2", "doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    of_anchors = blocks.totals(blocks.asks(dealt, anchor_keys, parts), 2)
    of_windows = blocks.totals(blocks.with_answers(dealt, of_anchors, ask_windows, blocks._ASK), 2)
    done = blocks.with_answers(
        dealt, of_anchors.unionByName(of_windows), cut,
        "k1 long, k2 long, doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")
    return blocks.for_all(done, names).drop("k1", "k2", *([] if texts else ["kept"]))
