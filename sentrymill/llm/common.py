"""What several operators share: words, stored intermediate tables, skew-proof lookups
and connected components.

The word rule is `[^\\x20\\x09-\\x0D]+` throughout. Python's `bytes.split()` cuts at
exactly these six bytes, so tasks work on UTF-8 bytes and never decode a text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentrymill.session import cut_lineage

WORD = r"[^\x20\x09-\x0D]+"
MOST_ROUNDS = 60   # of star contraction; 2^60 nodes in a chain would need more


class Memo(dict):
    """What a function gives for words it has seen, kept until there are many."""

    MOST = 300_000

    def __init__(self, function):
        super().__init__()
        self.function = function

    def __missing__(self, word):
        if len(self) >= self.MOST:
            self.clear()
        value = self[word] = self.function(word)
        return value


def texts_or_empty(name: str = "text") -> Column:
    """A text; null counts as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def text_bytes(name: str = "text") -> Column:
    """A text as UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(name).cast("string").cast("binary"), F.lit(b""))


def stored(df: DataFrame) -> DataFrame:
    """`df` written once to the shared folder and read again (see session.cut_lineage)."""
    return cut_lineage(df)


def spread_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """An equi-join in which each side has an exchange of its own below the join, so that
    adaptive execution can cut a partition that one key has filled. `right` may be an
    aggregate whose own partitioning would otherwise be taken over."""
    return left.join(right.hint("rebalance"), on, how)


def total_chars(docs: DataFrame) -> int:
    """Characters of all texts: one number, from which counts of parts are worked out."""
    return docs.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0


def parts_of(spark, amount: int, per_part: int) -> int:
    """How many parts to deal `amount` into: at least the session's shuffle partitions."""
    least = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(least, -(-amount // per_part))


def _checksum(edges: DataFrame):
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % (1 << 31)), ).first())


def components(edges: DataFrame) -> DataFrame:
    """Connected components of links (`a`, `b` long): each linked node with the smallest
    node it reaches, as (`node`, `root`).

    Large-star and small-star contraction: every round hangs the neighbours of a node on
    the smallest of them, so a chain of n nodes ends after about log n rounds. A round
    is joins and minima that combine on the map side, never a list of neighbours. Links
    stay in the shared folder; the driver sees a count and a checksum only. Null ends and
    self-links are ignored; no links give no rows.
    """
    now = stored(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    seen = _checksum(now)
    for _ in range(MOST_ROUNDS):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("_m")).select(
            "a", F.least("a", "_m").alias("_m"))
        large = stored(
            spread_join(both.where("b > a"), least, ["a"])
            .select(F.col("b").alias("a"), F.col("_m").alias("b")).distinct()
        )
        low = large.groupBy("a").agg(F.min("b").alias("_m"))
        below = spread_join(large, low, ["a"])
        small = stored(
            below.where("b <> _m").select(F.col("b").alias("a"), F.col("_m").alias("b"))
            .unionByName(low.select("a", F.col("_m").alias("b"))).distinct()
        )
        now, before, seen = small, seen, _checksum(small)
        if seen == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    raise RuntimeError("components did not settle")


def component_ids(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """`nodes` (`node` long, `least` = smallest id it stands for) with `component_id`, the
    smallest `least` among all nodes that `links` (`a`, `b`) connect it to."""
    roots = components(links)
    held = stored(
        nodes.join(roots.hint("rebalance"), "node", "left")
        .select("node", "least", F.coalesce("root", "node").alias("root"))
    )
    lowest = held.groupBy("root").agg(F.min("least").alias("component_id"))
    return spread_join(held, lowest, ["root"]).select("node", "component_id")
