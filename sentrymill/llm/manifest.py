"""Merkle manifest of a table, with a proof for every row.

Rows become leaves of one binary tree for each value of a column, ascending by id; the
roots of those trees are the leaves of one more tree. Trees are built in rounds: a group
holds BLOCK consecutive nodes of one tree and climbs to their common node, and these are
the next round's nodes. Nodes below the first round's tops are never stored.

Proofs work as octopus multiproofs. A block of leaves works out the coordinates of nodes
that all its leaves together need and that its own leaves do not give: the least union of
their siblings. They are looked up once for the block. With them the block derives every
interior node that its paths share, and expands the proof of each leaf locally.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentrymill.llm.common import parts_of, spread_join, stored

LEVELS = 10                 # of a tree that one group climbs: 2^10 leaves
ROWS_PER_PART = 1_000_000
TOP = -1                    # number of the tree over the trees
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_ROUND = "tree long, n long, level int, idx long, h string"
_LEAF_PASS = "tree long, block long, up long, level int, idx long, h string"
_PROOFS = ("tree long, idx long, doc_id long, leaf string, subroot string, root string, "
           "proof_sha256 string, folded_root string, verified boolean")


def leaf_hash(*fields: Column | str) -> Column:
    """Hex SHA-256 of a row: `-` for a null, else the count of UTF-8 bytes, `:` and the value."""
    def part(c: Column | str) -> Column:
        text = (F.col(c) if isinstance(c, str) else c).cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*map(part, fields)).cast("binary"), 256)


def join_hash(*hexes: str) -> str:
    """Hash of a node from the hex texts of its children, in order."""
    return hashlib.sha256("".join(hexes).encode()).hexdigest()


def depth(leaves: int) -> int:
    """Levels above the leaves until one node is left."""
    return max(int(leaves) - 1, 0).bit_length()


def climb(nodes: list[str], levels: int) -> list[list[str]]:
    """The levels from `nodes` up; every two consecutive nodes make one, a last one alone too."""
    out = [nodes]
    for _ in range(levels):
        below = out[-1]
        out.append([join_hash(*below[i:i + 2]) for i in range(0, len(below), 2)])
    return out


def missing(known: list[int], leaves: int) -> list[tuple[int, int]]:
    """(level, index) of the nodes needed to climb from the leaves `known` (ascending) to the
    root of a tree: siblings that no known leaf lies below. An octopus goes up level by level
    and asks for a sibling only where its arms do not already hold it."""
    asked, arms, width = [], list(known), leaves
    for level in range(depth(leaves)):
        held = set(arms)
        asked += [(level, i ^ 1) for i in arms if i ^ 1 < width and i ^ 1 not in held]
        arms, width = sorted({i // 2 for i in arms}), (width + 1) // 2
    return asked


class Manifest(NamedTuple):
    """`leaves` (tree, n, idx, top, doc_id, leaf, claim: a row for each row of the table),
    `nodes` (tree, level, idx, h: those above the first round, and the tree of trees),
    `wanted` (coordinates each block of leaves needs), `trees` (key, tree, n, subroot),
    `root` and the number of trees."""
    leaves: DataFrame
    nodes: DataFrame
    wanted: DataFrame
    trees: DataFrame
    root: str | None
    n_trees: int


def _numbered(rows: DataFrame, order: list, amount: int) -> DataFrame:
    """`rows` (a stored table) with `at`, their number in the given order from 0: sorted in
    ranges, written, and shifted by the rows of earlier ranges (one count for each range)."""
    parts = parts_of(rows.sparkSession, amount, ROWS_PER_PART)
    sorted_ = stored(
        rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
        .withColumn("_m", F.monotonically_increasing_id())
    )
    part = F.shiftright("_m", 33)
    counts = sorted(sorted_.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())
    before = dict(zip([r.p for r in counts], np.cumsum([0] + [r.n for r in counts]).tolist()))
    starts = rows.sparkSession.createDataFrame(list(before.items()) or [(0, 0)], "_p long, _before long")
    return sorted_.join(F.broadcast(starts), part == F.col("_p")).withColumn(
        "at", F.col("_before") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))).drop("_m", "_p", "_before")


def _table(rows: list[tuple], schema: str) -> pa.Table:
    """Rows as Arrow columns of a schema given as for Spark."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
    fields = [pa.field(name, kinds[kind]) for name, kind in (f.split() for f in schema.split(", "))]
    columns = list(zip(*rows)) or [[]] * len(fields)
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields)], schema=pa.schema(fields))


def _block(group: pa.Table) -> tuple[pa.Table, int, int, int]:
    """A group in order, its tree, the leaves of that tree and its first index."""
    group = group.sort_by("idx")
    return group, group["tree"][0].as_py(), group["n"][0].as_py(), group["idx"][0].as_py()


def _round(base: int):
    """The levels above one group of nodes of level `base`."""
    def up(group: pa.Table) -> pa.Table:
        group, tree, n, low = _block(group)
        levels = climb(group["h"].to_pylist(), min(LEVELS, depth(n) - base))
        return _table([(tree, n, base + k, (low >> k) + i, h)
                       for k, row in enumerate(levels) if k for i, h in enumerate(row)], _ROUND)

    return up


def _climbed(nodes: DataFrame, most: int, bottom: int) -> list[DataFrame]:
    """Node tables (tree, n, level, idx, h) of the rounds above `nodes`, which hold level
    `bottom` of trees of at most `most` leaves. Each table holds the levels of its round; a
    tree that has reached its root takes no part any more."""
    tables = []
    while bottom < depth(most):
        made = stored(
            nodes.where(F.lit(bottom) < F.col("_depth"))
            .select("tree", "n", "idx", "h", F.shiftright("idx", LEVELS).alias("block"))
            .groupBy("tree", "block").applyInArrow(_round(bottom), _ROUND)
        )
        tables.append(made)
        bottom += LEVELS
        nodes = _with_depth(made.where(F.col("level") == bottom))
    return tables


def _with_depth(nodes: DataFrame) -> DataFrame:
    """Adds the depth of a tree of `n` leaves: binary digits of n - 1."""
    return nodes.withColumn("_depth", F.when(F.col("n") > 1, F.length(F.bin(F.col("n") - 1))).otherwise(0))


def build(
    docs: DataFrame, fields: tuple[str, ...] = FIELDS, tree: str = "lang", order: str = "doc_id",
    claim: Column | None = None,
) -> Manifest:
    """The manifest of `docs`: leaves over `fields`, a tree for each value of `tree`.

    `claim` is a leaf hash to be proved in place of a row's own (null: its own). Trees are
    ordered null first, then bytewise; leaves by `order`, nulls first, then by hash, so rows
    that repeat an id have a fixed order. Rows alike in all fields are leaves of their own.
    Other columns count nowhere. An empty table has no trees and no root. Starts jobs; what
    is written are hashes, once for each range of leaves, and interior nodes.
    """
    rows = stored(docs.select(
        F.col(order).cast("long").alias("doc_id"), F.col(tree).cast("string").alias("key"),
        leaf_hash(*[f"`{c}`" for c in fields]).alias("leaf"),
        (F.lit(None) if claim is None else claim).cast("string").alias("claim"),
        F.monotonically_increasing_id().alias("_salt"),    # splits rows that are alike
    ))
    counts = stored(rows.groupBy("key").agg(F.count("*").alias("n")))
    total, n_trees, most = counts.agg(F.sum("n"), F.count("*"), F.max("n")).first()
    first = lambda c: F.col(c).asc_nulls_first()
    trees = stored(_numbered(counts, [first("key")], n_trees).withColumnRenamed("at", "tree"))
    placed = _numbered(rows, [first("key"), first("doc_id"), F.col("leaf"), F.col("_salt")], total or 0)
    # the first leaf of a tree: leaves of all trees lie one after the other
    begin = placed.groupBy("key").agg(F.min("at").alias("_first"))
    about = trees.join(begin, trees["key"].eqNullSafe(begin["key"])).select(trees["key"].alias("_key"), "tree", "n", "_first")
    leaves = stored(
        placed.join(about.hint("rebalance"), F.col("key").eqNullSafe(F.col("_key")))
        .select("tree", "n", (F.col("at") - F.col("_first")).alias("idx"), "doc_id", "leaf", "claim")
    )

    def leaf_pass(group: pa.Table) -> pa.Table:
        group, number, n, low = _block(group)
        high = min(LEVELS, depth(n))
        top = climb(group["h"].to_pylist(), high)[-1][0]
        # `up` names the tree that a coordinate lies in; a null one is the block's own top
        out = [(number, low >> LEVELS, None, high, low >> high, top)]
        out += [(number, low >> LEVELS, number, *c, None) for c in missing(group["idx"].to_pylist(), n)]
        out += [(number, low >> LEVELS, TOP, *c, None) for c in missing([number], n_trees)]
        return _table(out, _LEAF_PASS)

    passed = stored(
        leaves.select("tree", "n", "idx", F.col("leaf").alias("h"), F.shiftright("idx", LEVELS).alias("block"))
        .groupBy("tree", "block").applyInArrow(leaf_pass, _LEAF_PASS)
    )
    sizes = trees.select("tree", "n")
    tops = stored(_with_depth(spread_join(passed.where("up is null").select("tree", "level", "idx", "h"), sizes, ["tree"])))
    tables = [tops.drop("_depth").select("tree", "n", "level", "idx", "h"), *_climbed(tops, most or 0, LEVELS)]
    own = tables[0]
    for table in tables[1:]:
        own = own.unionByName(table)
    subroots = stored(_with_depth(own).where("level = _depth").select("tree", "h"))
    over = subroots.select(F.lit(TOP).cast("long").alias("tree"), F.lit(n_trees).cast("long").alias("n"),
                           F.lit(0).alias("level"), F.col("tree").alias("idx"), "h")
    above = [over, *_climbed(_with_depth(over), n_trees, 0)]
    nodes = own.select("tree", "level", "idx", "h")
    for table in above:
        nodes = nodes.unionByName(table.select("tree", "level", "idx", "h"))
    nodes = stored(nodes)
    root = nodes.where((F.col("tree") == TOP) & (F.col("level") == depth(n_trees))).select("h").first()
    named = spread_join(trees.select("key", "tree", "n"), subroots.withColumnRenamed("h", "subroot"), ["tree"])
    wanted = passed.where("up is not null").select("tree", "block", "up", "level", "idx")
    return Manifest(leaves, nodes, wanted, named, root and root.h, n_trees)


def proofs(made: Manifest) -> DataFrame:
    """A row for every leaf: its path to the root, hashed, and what its claim folds to.

    Columns `tree`, `idx`, `doc_id`, `leaf`, `subroot`, `root`, `proof_sha256` (hash of the
    siblings' hex texts, from the leaf up), `folded_root` (from the claim, else the leaf) and
    `verified`. A tree of one leaf has no sibling below its subroot; a single row's proof is
    the hash of nothing. A group holds one block of leaves and at most two nodes for each level.
    """
    root, n_trees = made.root, made.n_trees
    fetched = spread_join(
        made.wanted, made.nodes.select(F.col("tree").alias("up"), "level", "idx", "h"), ["up", "level", "idx"])
    blocks = made.leaves.withColumn("block", F.shiftright("idx", LEVELS))

    def expand(group: pa.Table, nodes: pa.Table) -> pa.Table:
        group, tree, n, low = _block(group)
        held = {c[:3]: c[3] for c in zip(*(nodes[name].to_pylist() for name in ("up", "level", "idx", "h")))}
        inner = min(LEVELS, depth(n))
        local = climb(group["leaf"].to_pylist(), inner)

        # what lies above the block is the same for all its leaves: (sibling, it comes first)
        shared, at = [], low >> inner
        for number, position, base, high in ((tree, at, inner, depth(n)), (TOP, tree, 0, depth(n_trees))):
            for level in range(base, high):
                sibling = held.get((number, level, position ^ 1))
                shared.append((sibling, position & 1) if sibling else None)
                position >>= 1
        above = "".join(s[0] for s in shared if s)

        def lift(h: str, steps: list = shared) -> str:
            for s in steps:
                h = join_hash(h) if s is None else join_hash(s[0], h) if s[1] else join_hash(h, s[0])
            return h

        subroot = lift(local[-1][0], shared[:depth(n) - inner])
        derived = lift(local[-1][0])
        rows = []
        for i, (idx, doc, leaf, claim) in enumerate(zip(*(group[c].to_pylist() for c in ("idx", "doc_id", "leaf", "claim")))):
            siblings, position = [], i
            folded = claim
            for level in range(inner):
                row, other = local[level], position ^ 1
                sibling = row[other] if other < len(row) else ""
                siblings.append(sibling)
                if claim is not None:
                    folded = join_hash(sibling, folded) if position & 1 else join_hash(folded, sibling)
                position >>= 1
            # an unchanged leaf folds through the interiors derived above
            folded = derived if claim is None else lift(folded)
            rows.append((tree, idx, doc, leaf, subroot, root, join_hash(*siblings, above), folded, folded == root))
        return _table(rows, _PROOFS)

    return blocks.groupBy("tree", "block").cogroup(fetched.groupBy("tree", "block")).applyInArrow(expand, _PROOFS)
