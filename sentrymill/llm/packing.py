"""Packing of tokenised documents into sequences of one length.

A task turns texts into token ids and cuts long ones into pieces; each piece gets its rank
among the pieces of its length in that task. What decides the packing is how many pieces
there are of each length: at most `capacity` numbers, whatever the size of the table. On
these the plan is made: sequences are combinations of lengths taken many times over. A
length is paired with one, two or three lengths that fill its gap exactly, as often as the
counts allow; lengths without an exact complement are packed best-fit. Pieces then find
their sequence and place by length and rank.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sentrymill.llm.common import Memo, spread_join, stored, texts_or_empty
from sentrymill.llm.quality import _pieces

CAPACITY = 1024
END_ID = 2
SLACKS = (0, 32, CAPACITY)    # of gaps, see plan()
# Unicode white space and ASCII punctuation as fixed values. The tokenizer's byte-level rule
# always opens a new unit where a run of white space begins, and where punctuation follows a
# letter or digit, so a text can be cut there and the ids put side by side.
SPACE = "\\t\\n\\x0b\\x0c\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
MARKS = "!-/:-@\\[-`{-~"
LETTERS = "A-Za-z\\u00c0-\\u00d6\\u00d8-\\u00f6\\u00f8-\\u024f"
_CLOSED = f"(?![^{MARKS}{SPACE}])"
_UNIT = re.compile(
    f" ?[{LETTERS}]+{_CLOSED}|\\n(?=[^{SPACE}])|[{SPACE}]*[0-9{LETTERS}]+{_CLOSED}|[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
_WORD = re.compile(f" ?[{LETTERS}]+")
MOST_UNITS = 500_000          # remembered by a task, none longer than this:
MOST_LETTERS = 64
_PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long, part int, nth long"


class _Units(Memo):
    MOST = MOST_UNITS

    def __missing__(self, unit):
        return super().__missing__(unit) if len(unit) <= MOST_LETTERS else self.function(unit)


def _raw(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Encoder:
    """Token ids of texts as little-endian 32-bit numbers, by a byte-level vocabulary of
    `tokenizers`; units that came before are remembered."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.spell = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        named = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, named))) if named else None
        self.known = _Units(self.unit)

    def whole(self, text: str) -> bytes:
        return _raw(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def unit(self, unit: str) -> bytes:
        if _WORD.fullmatch(unit):          # one unit of the tokenizer: straight to its merges
            spelt = unit.replace(" ", "\u0120") if unit.isascii() else self.spell(unit)[0][0]
            return _raw([t.id for t in self.model.tokenize(spelt)])
        return self.whole(unit)

    def encode(self, texts: list[str]) -> list[bytes]:
        known, out = self.known, []
        for text in texts:
            if self.special and self.special.search(text):
                out.append(self.whole(text))
            else:
                out.append(b"".join([known[u] for u in _UNIT.findall(text)]))
        return out


def cuts(total: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document: full ones, but for a shorter first."""
    first = total % capacity or min(total, capacity)
    return [(0, first)] + [(at, capacity) for at in range(first, total, capacity)]


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, ids: bool = True) -> DataFrame:
    """Pieces of all documents: `doc_id`, `piece`, `start`, `length`, `ids_crc32`, with
    `ids` (binary, little-endian 32-bit) if asked for, and `part`, `nth`: the task that made
    the piece and its number among that task's pieces of this length.

    `path` names a tokenizer file that every executor can open. A null text is empty, and an
    empty one is the closing id alone. Written once before it is used, so that ranks stay as
    they are when executors are lost.
    """
    names = [f.split()[0] for f in _PIECES.split(", ")] + ["ids"] * ids

    def run(batches):
        from pyspark import TaskContext

        part, seen, encoder = TaskContext.get().partitionId(), Counter(), None
        close = np.uint32(end_id).astype("<u4").tobytes()
        for batch in _pieces(batches):
            encoder = encoder or Encoder(path)
            out = [[] for _ in names]
            for doc, raw in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1).to_pylist())):
                raw += close
                for number, (start, length) in enumerate(cuts(len(raw) // 4, capacity)):
                    own = raw[4 * start:4 * (start + length)]
                    row = (doc, number, start, length, zlib.crc32(own), part, seen[length], own)
                    seen[length] += 1
                    for column, value in zip(out, row):
                        column.append(value)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), texts_or_empty().alias("text"))
    return stored(rows.mapInArrow(run, _PIECES + (", ids binary" if ids else "")))


class Shelf(NamedTuple):
    """A combination of lengths, as (length, copies), and how many sequences hold it."""
    lengths: tuple[tuple[int, int], ...]
    times: int


class _Sums:
    """Which lengths are left, and how many pairs of lengths left have each sum."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.left = np.zeros(capacity + 1, np.int64)
        for length, n in counts.items():
            self.left[length] = n
        self.pairs = np.zeros(2 * capacity + 1, np.int64)
        held = np.flatnonzero(self.left)
        for i, a in enumerate(held):
            self.pairs[a + held[i:]] += 1

    def take(self, shelf: Counter, times: int) -> None:
        for length, copies in shelf.items():
            self.left[length] -= copies * times
            if not self.left[length]:
                held = np.flatnonzero(self.left)
                self.pairs[length + held] -= 1
                self.pairs[2 * length] -= 1

    def pair(self, total: int) -> tuple[int, int] | None:
        """Two lengths left with this sum, the longest that there is first."""
        if total < 2 or not self.pairs[total]:
            return None
        high = np.arange(total - 1, (total - 1) // 2, -1)
        at = np.flatnonzero((self.left[high] > 0) & (self.left[total - high] > 0))
        return int(high[at[0]]), int(total - high[at[0]])

    def exact(self, gap: int) -> list[list[int]]:
        """Combinations of one, two and three lengths left that fill the gap."""
        found = [[gap]] if self.left[gap] else []
        two = self.pair(gap)
        if two:
            found.append(list(two))
        longest = np.arange(gap - 2, 0, -1)
        for a in longest[(self.left[longest] > 0) & (self.pairs[gap - longest] > 0)]:
            found.append([int(a), *self.pair(gap - int(a))])
            break
        return found


def _best_fit(left: dict[int, int], capacity: int) -> list[Shelf]:
    """Best-fit decreasing over counts: each length goes where the gap left is smallest."""
    open_: dict[int, list[tuple[tuple, int]]] = {}     # gap: (lengths so far, sequences)
    for length in sorted(left, reverse=True):
        n = left[length]
        while n:
            gap = min((g for g in open_ if g >= length), default=None)
            held, times = open_[gap].pop() if gap is not None else ((), n)
            if gap is not None and not open_[gap]:
                del open_[gap]
            room = capacity if gap is None else gap
            copies = min(room // length, n)
            used = min(times, n // copies)
            open_.setdefault(room - copies * length, []).append((held + ((length, copies),), used))
            if held and times > used:
                open_.setdefault(room, []).append((held, times - used))
            n -= used * copies
    return [Shelf(held, times) for group in open_.values() for held, times in group]


def _exact_plan(counts: dict[int, int], capacity: int, slack: int) -> list[Shelf]:
    sums, shelves = _Sums(counts, capacity), []
    for length in range(capacity, 0, -1):
        gap, least = capacity - length, max(capacity - length - slack, 0)
        while sums.left[length] and gap >= least:
            shelf, times = None, 0
            for rest in sums.exact(gap) if gap else [[]]:
                shelf = Counter([length, *rest])
                times = min(int(sums.left[x]) // copies for x, copies in shelf.items())
                if times:
                    break
            if times:
                sums.take(shelf, times)
                shelves.append(Shelf(tuple(sorted(shelf.items(), reverse=True)), times))
            else:
                gap -= 1
    return shelves + _best_fit({int(x): int(sums.left[x]) for x in np.flatnonzero(sums.left)}, capacity)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[Shelf]:
    """Shelves that hold every piece, from the number of pieces of each length.

    From the longest length down: as long as one, two or three of the lengths left fill the
    gap exactly, the combination is taken as often as the counts allow, which uses up one of
    its lengths but for a remainder below its copies. So the number of shelves goes with the
    number of lengths, not with the pieces. What finds no complement is packed best-fit at
    the end. Where exact complements are rare it can be better to give a little away early,
    so gaps that stay open by up to `SLACKS` are tried too, as is best fit alone; the plan
    with the fewest sequences is taken, the exact one on a tie.
    """
    plans = [_exact_plan(counts, capacity, slack) for slack in SLACKS] + [_best_fit(counts, capacity)]
    return min(plans, key=lambda shelves: sum(s.times for s in shelves))


class _Places(NamedTuple):
    """Where the pieces of a length go by rank: sorted starts of runs, and for each run the
    first rank, first sequence, copies of the length in a sequence and offset of the first."""
    key: np.ndarray
    first: np.ndarray
    sequence: np.ndarray
    copies: np.ndarray
    offset: np.ndarray


_RANKS = 44     # bits of a rank in a key


def places(shelves: list[Shelf]) -> _Places:
    rows, ranks, sequence = [], Counter(), 0
    for shelf in shelves:
        offset = 0
        for length, copies in shelf.lengths:
            rows.append((length << _RANKS | ranks[length], ranks[length], sequence, copies, offset))
            ranks[length] += copies * shelf.times
            offset += copies * length
        sequence += shelf.times
    return _Places(*np.array(sorted(rows), np.int64).reshape(-1, 5).T)


def place(made: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """`made` (rows of pieces()) with `sequence_id` and `offset`, without `part` and `nth`.

    Rank of a piece among all of its length: pieces of earlier tasks, from one count for
    each task and length, plus its number in its own. The counts by length (`capacity`
    numbers at most) come to the driver; the plan goes to the tasks, a few runs for each
    length. No pieces give no rows. Starts a job when called.
    """
    counts = made.groupBy("part", "length").agg(F.count("*").alias("n"))
    totals = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    where = places(plan(totals, capacity))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    earlier = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_earlier"))
    ranked = spread_join(made, earlier, ["part", "length"])
    columns = [c for c in made.columns if c not in ("part", "nth")]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in made.schema if f.name in columns)

    def run(batches):
        for batch in batches:
            length = batch.column("length").to_numpy().astype(np.int64)
            rank = pc.add(batch.column("nth"), batch.column("_earlier")).to_numpy()
            at = np.searchsorted(where.key, (length << _RANKS) | rank, "right") - 1
            nth = rank - where.first[at]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in columns]
                + [pa.array(where.sequence[at] + nth // where.copies[at]),
                   pa.array(where.offset[at] + nth % where.copies[at] * length)],
                [*columns, "sequence_id", "offset"])

    return ranked.select(*columns, "nth", "_earlier").mapInArrow(run, schema + ", sequence_id long, offset long")


def pack(
    docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, ids: bool = True
) -> DataFrame:
    """Pieces of all documents with `sequence_id` and `offset`: sequences of at most
    `capacity` tokens without gaps, each document followed by `end_id`.

    Only documents above `capacity` are cut, the first piece being the shorter one. A null
    or empty text is a piece of one id; repeated rows are packed each time; rows without
    doc_id are packed as well. Other columns are left out. Every run uses as many sequences;
    which piece meets which may differ.
    """
    return place(pieces(docs, path, capacity, end_id, ids), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """The rows to train on: `sequence_id`, `ids` (binary, little-endian 32-bit) and `parts`,
    the pieces in it as (offset, length, doc_id, piece). A group holds one sequence."""
    held = F.sort_array(F.collect_list(F.struct("offset", "length", "doc_id", "piece", "ids")))
    return packed.groupBy("sequence_id").agg(held.alias("_p")).select(
        "sequence_id",
        F.aggregate("_p", F.lit(b""), lambda a, p: F.concat(a, p["ids"])).alias("ids"),
        F.transform("_p", lambda p: F.struct(p["offset"], p["length"], p["doc_id"], p["piece"])).alias("parts"),
    )
