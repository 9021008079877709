"""How filters of documents interact: what each removes under every order of applying them.

A task reduces a text to one failure mask and a 128-bit hash of the text. Masks are counted
by part, at most 2^filters rows for each, and a part's counts become a decision diagram: a
level for each filter, a low edge for documents that pass it and a high edge for those that
fail, equal sub-diagrams shared, the counts summed up at every node. Swapping two adjacent
levels touches these two only, and adjacent swaps alone lead through all orders. In each
order the path of low edges is what is left after every step, and the high edge hanging off
it is what the step removes.
"""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentrymill.llm.common import spread_join, stored, text_bytes
from sentrymill.llm.quality import _pieces

FILTERS = "ABCDE"
LEAST_WORDS = 50       # A: fewer fail
LEAST_DISTINCT = 65    # B: fewer different words in a hundred fail
MOST_CAPITALS = 5      # C: more capitals in a hundred code points fail
MARKS = b"#$%&*|"      # D: any of them fails; E: a smaller doc_id has the same text

_CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
_CONTINUED = bytes(range(0x80, 0xC0))   # bytes of a code point after its first
_MASKS = "doc_id long, part string, mask int, h1 long, h2 long"
_REPORT = ("part string, filter_order string, step int, kept long, removed long, redundant long, "
           "unique_fails long, good_lost long, toxic_lost long, shapley long")


def text_mask(text: bytes) -> int:
    """Bits of the filters A to D that a text fails."""
    words = text.split()
    n = len(words)
    capitals = len(text) - len(text.translate(None, _CAPITALS))
    points = len(text.translate(None, _CONTINUED))
    return (
        (n < LEAST_WORDS)
        | (100 * len(set(words)) < LEAST_DISTINCT * n) << 1
        | (100 * capitals > MOST_CAPITALS * points) << 2
        | (len(text.translate(None, MARKS)) < len(text)) << 3
    )


def failure_masks(docs: DataFrame, part: str = "source") -> DataFrame:
    """`doc_id`, `part` and `mask` (bit i: fails filter i) of every row.

    A null text is empty, a null part the empty string. Filter E fails where some smaller
    doc_id has the same text; rows that repeat one doc_id do not fail each other, and a row
    without doc_id neither fails E nor makes another fail. Starts a job when called: masks
    and hashes are written once, texts are read once and never shuffled. A text that very
    many rows share is one row of the minima, and the join back cuts such a key.
    """
    def run(batches):
        for batch in _pieces(batches):
            ids, texts, parts = batch.columns
            masks, lows, highs = [], [], []
            for text in texts.to_pylist():
                digest = xxhash.xxh3_128_digest(text)
                masks.append(text_mask(text))
                lows.append(int.from_bytes(digest[:8], "big", signed=True))
                highs.append(int.from_bytes(digest[8:], "big", signed=True))
            yield pa.RecordBatch.from_arrays(
                [ids, parts, pa.array(masks, pa.int32()), pa.array(lows, pa.int64()), pa.array(highs, pa.int64())],
                ["doc_id", "part", "mask", "h1", "h2"])

    rows = stored(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"),
        F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
    ).mapInArrow(run, _MASKS))
    first = rows.groupBy("h1", "h2").agg(F.count("*").alias("_n"), F.min("doc_id").alias("_first")).where(
        "_n > 1").drop("_n")
    later = F.coalesce(F.col("doc_id") > F.col("_first"), F.lit(False))
    return spread_join(rows, first, ["h1", "h2"], "left").select(
        "doc_id", "part", F.col("mask").bitwiseOR(later.cast("int") * 16).alias("mask"))


def mask_counts(masks: DataFrame, good: Column, toxic: Column) -> DataFrame:
    """`n`, `good` and `toxic` rows for each `part` and `mask`; summed on the map side."""
    yes = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    return masks.groupBy("part", "mask").agg(
        F.count("*").alias("n"), yes(good).alias("good"), yes(toxic).alias("toxic"))


def _add(a: tuple, b: tuple) -> tuple:
    return tuple(x + y for x, y in zip(a, b))


class Diagram:
    """Counts of failure masks as an ordered decision diagram.

    `nodes[k]` maps a node of level k to its (low, high) nodes of the next level;
    `weights[k]` maps it to the counts of all masks below it. `order[k]` is the filter that
    level k asks about. Terminals are the different count tuples.
    """

    def __init__(self, counts: dict[int, tuple], width: int):
        self.order = list(range(width))
        self.nodes = [{} for _ in range(width)]
        self.weights = [{} for _ in range(width + 1)]
        names = [{} for _ in range(width + 1)]
        none = (0,) * len(next(iter(counts.values())))
        below = [counts.get(mask, none) for mask in self._masks(width)]
        level = [names[width].setdefault(c, len(names[width])) for c in below]
        self.weights[width] = {name: c for c, name in names[width].items()}
        for k in reversed(range(width)):
            pairs = list(zip(level[::2], level[1::2]))
            level = [names[k].setdefault(p, len(names[k])) for p in pairs]
            for pair, name in names[k].items():
                self._put(k, name, pair)
        self.root = level[0]

    @staticmethod
    def _masks(width: int) -> list[int]:
        """All masks in the order of the paths, low edges first."""
        masks = [0]
        for bit in range(width):
            masks = [m | high for m in masks for high in (0, 1 << bit)]
        return masks

    def _put(self, k: int, name: int, pair: tuple[int, int]) -> None:
        self.nodes[k][name] = pair
        self.weights[k][name] = _add(self.weights[k + 1][pair[0]], self.weights[k + 1][pair[1]])

    def swap(self, k: int) -> None:
        """Exchange levels k and k + 1. Nodes of level k keep their names, so nothing above
        changes; nodes of level k + 1 are made anew and shared where equal."""
        upper, lower = self.nodes[k], self.nodes[k + 1]
        self.nodes[k + 1], self.weights[k + 1], names = {}, {}, {}

        def node(low: int, high: int) -> int:
            name = names.setdefault((low, high), len(names))
            if name not in self.nodes[k + 1]:
                self._put(k + 1, name, (low, high))
            return name

        for name, (low, high) in upper.items():
            (ll, lh), (hl, hh) = lower[low], lower[high]
            upper[name] = (node(ll, hl), node(lh, hh))
        self.order[k], self.order[k + 1] = self.order[k + 1], self.order[k]

    def steps(self):
        """Filter, counts kept and counts removed along the path that passes all filters."""
        at = self.root
        for k, which in enumerate(self.order):
            low, high = self.nodes[k][at]
            yield which, self.weights[k + 1][low], self.weights[k + 1][high]
            at = low


def adjacent_swaps(width: int):
    """Positions of adjacent swaps that lead from one order through all the others."""
    order, way = list(range(width)), [-1] * width
    while True:
        for item in reversed(range(width)):      # the largest item that can still move
            at = order.index(item)
            to = at + way[item]
            if 0 <= to < width and order[to] < item:
                break
        else:
            return
        yield min(at, to)
        order[at], order[to] = order[to], order[at]
        for larger in range(item + 1, width):
            way[larger] = -way[larger]


def part_report(counts: dict[int, tuple], letters: str = FILTERS) -> list[tuple]:
    """(filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    shapley) for every order and step, from the (n, good, toxic) counts of each mask."""
    width = len(letters)
    diagram = Diagram(counts, width)
    fails = [0] * width
    for mask, count in counts.items():
        for i in range(width):
            fails[i] += count[0] * (mask >> i & 1)
    rows, unique, shapley = [], [0] * width, [0] * width

    def walk():
        name = "".join(letters[i] for i in diagram.order)
        for step, (which, kept, removed) in enumerate(diagram.steps(), 1):
            rows.append((which, name, step, kept[0], removed))
            shapley[which] += removed[0]
            if step == width:      # asked last, it removes what fails nothing else
                unique[which] = removed[0]

    walk()
    for k in adjacent_swaps(width):
        diagram.swap(k)
        walk()
    return [(name, step, kept, lost[0], fails[i] - lost[0], unique[i], lost[1], lost[2], shapley[i])
            for i, name, step, kept, lost in rows]


def interactions(counts: DataFrame, letters: str = FILTERS) -> DataFrame:
    """The report of every `part` of mask_counts(): a row for each order of `letters` and step.

    A group is one part's counts, at most 2^filters rows however many documents it has. The
    number of rows is parts times orders times filters. No counts give no rows.
    """
    names = _REPORT.replace(",", "").split()[::2]

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        held = {int(m): (int(n), int(g), int(t)) for m, n, g, t in
                zip(group["mask"], group["n"], group["good"], group["toxic"])}
        return pd.DataFrame([(key[0], *row) for row in part_report(held, letters)], columns=names)

    return counts.groupBy("part").applyInPandas(run, _REPORT)


def audit(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """interactions() of the five filters over `docs`, with `good_lost` and `toxic_lost` by
    `labels` (doc_id, quality, toxic).

    A label counts if any row of its doc_id gives it; labels without doc_id count nowhere,
    and a document without doc_id or label is neither good nor toxic. Repeated documents
    count each time. No documents give no rows.
    """
    marked = labels.where("doc_id is not null and (quality = 1 or toxic = 1)").groupBy(
        F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("_good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("_toxic"))
    masks = spread_join(failure_masks(docs, part), marked, ["doc_id"], "left")
    return interactions(mask_counts(masks, F.col("_good"), F.col("_toxic")))
