"""Mixing sources to target weights by the cube method.

A source's target over its size gives every document the same expected number of copies:
the whole part is taken outright, the fraction is an inclusion probability. The
probabilities then move through the null-space of two constraints, the number of
documents and the number of words taken, until each is 0 or 1: three documents at a time,
since three unknowns under two constraints leave one direction to move in. Each chunk of
a source does so on its own and hands on the at most two documents it could not settle;
those of many chunks meet in a next chunk, and the last dozen of a source are landed on
the choice nearest to its target. Each source ends at the level where it is down to one
chunk, whatever the others hold.
"""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sentrymill.llm.common import WORD, stored

WEIGHTS = (1.0, 2.0, 3.0)    # of the sources in code-point order, repeating, null last
MOST_COPIES = 3.0            # a target is at most this many times its source's size
CHUNK = 1000                 # documents settled together
SPARE = 12                   # documents kept for the landing: 2^14 choices at most
_EPS = 1e-9


def sizes(docs: DataFrame) -> DataFrame:
    """Row identity, source and number of words of every row."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("sub"),
        F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
    )


def targets(sized: DataFrame, weights=WEIGHTS, most: float = MOST_COPIES) -> DataFrame:
    """One row per source: `source`, `docs`, `source_size`, `target`, `rate`, `k` (its
    place in order).

    Targets share the total of all sizes by weight; what a target has above `most` times
    its source's size is shared among the others until none is above. In falling order of
    weight over size the capped sources come first, so running sums find the share.
    Windows here run over one row per source, not over documents.
    """
    per = sized.groupBy("source").agg(F.count("*").alias("docs"), F.sum("size").alias("source_size"))
    ranked = per.withColumn("k", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("k") % len(weights) + 1).cast("int"))
    everything = Window.orderBy(F.col("_cap") / F.col("_w"), "k")
    before = everything.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    led = (
        ranked.withColumn("_w", w).withColumn("_cap", F.col("source_size") * F.lit(most))
        .withColumn("_share",
                    (F.sum("source_size").over(whole) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
                    / (F.sum("_w").over(whole) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))))
        .withColumn("_capped", F.col("_cap") < F.col("_share") * F.col("_w"))
        .withColumn("_level", F.min(F.when(~F.col("_capped"), F.struct(F.col("_cap") / F.col("_w"), "k", "_share"))).over(whole)["_share"])
    )
    target = F.when(F.col("_capped"), F.col("_cap")).otherwise(F.col("_level") * F.col("_w"))
    return led.withColumn("target", F.least(target, F.col("_cap"))).select(
        "source", "k", "docs", "source_size", "target",
        F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("rate"),
    )


def flight(chance: list[float], size: list[int], rng: random.Random, spare: int = 0) -> list[int]:
    """Move `chance` in place until at most two entries, and the last `spare`, are strictly
    between 0 and 1; the sums of chances and of chance times size stay the same. Returns
    the entries left."""
    open_, held = [i for i, p in enumerate(chance) if _EPS < p < 1 - _EPS], []
    flown = max(0, len(open_) - spare)
    for i in open_[:flown]:
        held.append(i)
        if len(held) < 3:
            continue
        a, b, c = held
        u = (size[c] - size[b], size[a] - size[c], size[b] - size[a])
        if not any(u):
            u = (1, -1, 0)
        up = min((1 - chance[j]) / d if d > 0 else -chance[j] / d for j, d in zip(held, u) if d)
        down = min(chance[j] / d if d > 0 else (chance[j] - 1) / d for j, d in zip(held, u) if d)
        step = up if rng.random() * (up + down) < down else -down
        for j, d in zip(held, u):
            p = chance[j] + step * d
            chance[j] = 0.0 if p < _EPS else 1.0 if p > 1 - _EPS else p
        held = [j for j in held if 0.0 < chance[j] < 1.0]
    return held + open_[flown:]


def land(chance: list[float], size: list[int], held: list[int]) -> None:
    """Settle the last entries of a source on the choice whose words are nearest to what
    their chances promise; a document more or less weighs as much as one in twenty of a
    mean document's words."""
    if not held:
        return
    p, sizes_ = np.array([chance[j] for j in held]), np.array([size[j] for j in held], np.float64)
    choices = (np.arange(1 << len(held))[:, None] >> np.arange(len(held))) & 1
    words = np.abs(choices @ sizes_ - p @ sizes_)
    cost = words / max(1.0, sizes_.mean()) + 0.05 * np.abs(choices.sum(axis=1) - p.sum())
    for x, j in zip(choices[int(np.argmin(cost))], held):
        chance[j] = float(x)


_ROW = "k long, chunks long, chunk long, seq long, doc_id long, sub long, size long, chance double"


def _settle(level: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["seq", "doc_id", "sub", "size"], kind="stable", na_position="last").reset_index(drop=True)
        chance, size = rows["chance"].tolist(), rows["size"].tolist()
        # the chunks of a source share the dozen; from a dozen on, each leaves enough itself
        chunks = int(rows["chunks"].iloc[0])
        spare = -(-SPARE // chunks) if chunks < SPARE else 0
        held = flight(chance, size, random.Random(f"{key[0]} {key[1]} {level}"), spare)
        if chunks == 1:
            land(chance, size, held)
        rows["chance"] = chance
        return rows

    return run


_SLICE = 1000


def copies(sized: DataFrame) -> DataFrame:
    """The rows of `sized` with `seq`, a number that deals them out evenly: it hangs on id, text
    and the number among rows alike in all, so rows that repeat a document do not meet in one
    chunk. Rows alike are counted on the map side and told apart again in slices."""
    same = sized.groupBy(*sized.columns).agg(F.count("*").alias("_n"))
    sliced = same.withColumn("_slice", F.explode(F.expr(f"sequence(0L, (_n - 1) div {_SLICE})"))).hint("rebalance")
    each = sliced.withColumn("_copy", F.explode(F.expr(f"sequence(_slice * {_SLICE}, least(_n, (_slice + 1) * {_SLICE}) - 1)")))
    return each.withColumn("seq", F.when(F.col("_copy") == 0, F.xxhash64("doc_id", "sub")).otherwise(
        F.xxhash64("doc_id", "sub", "_copy"))).drop("_n", "_slice", "_copy")


def mix(docs: DataFrame, weights=WEIGHTS, most: float = MOST_COPIES) -> DataFrame:
    """One row per input row: `doc_id`, `sub`, `size`, `source_size`, `target`, `taken`.

    `size` is the number of words (null text: 0); `taken` the words the mix takes of the
    row, repeats counted: its size times a number of copies of at most `most` rounded up.
    A null source is a source of its own, last in order. Rows without words take nothing.
    Repeated rows are rows of their own. The same rows give the same mix on any cluster:
    chunks and chances hang on ids and texts alone. Starts jobs when called; sizes and
    chances are kept in the shared folder.
    """
    sized = stored(sizes(docs))
    goals = stored(targets(sized, weights, most))
    rows = (
        copies(sized).join(goals.withColumnRenamed("source", "_source").hint("rebalance"), F.col("source").eqNullSafe(F.col("_source")))
        .withColumn("chance", F.when(F.col("size") > 0, F.col("rate") - F.floor("rate")).otherwise(0.0))
        .withColumn("chunks", F.expr(f"greatest(1, ceil(docs / {CHUNK}L))"))
        .withColumn("chunk", F.expr("pmod(seq, chunks)"))
        .select(*[c.split()[0] for c in _ROW.split(", ")])
    )
    chunks, level, done = -(-(goals.agg(F.max("docs")).first()[0] or 0) // CHUNK), 0, []
    while True:
        now = stored(rows.groupBy("k", "chunk").applyInPandas(_settle(level), _ROW))
        unsettled = F.col("chance").between(_EPS, 1 - _EPS)
        done.append(now.where(~unsettled))
        if chunks <= 1:
            break
        # two at most come from each of many chunks, so CHUNK / 2 chunks meet in one;
        # sources of one chunk are settled and have no rows here
        rows = now.where(unsettled).withColumn("chunk", F.expr(f"chunk div {CHUNK // 2}L")).withColumn(
            "chunks", F.expr(f"ceil(chunks / {CHUNK // 2}L)"))
        chunks, level = -(-chunks // (CHUNK // 2)), level + 1
    settled = done[0]
    for more in done[1:]:
        settled = settled.unionByName(more)
    return settled.join(goals, "k").select(
        "doc_id", "sub", "size", "source_size", "target",
        (F.col("size") * (F.floor("rate") + F.round("chance"))).cast("long").alias("taken"),
    )


_ADDED = ("size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, weights=WEIGHTS, most: float = MOST_COPIES) -> DataFrame:
    """The rows of `docs` that the mix takes, with `size`, `source_size`, `target` and
    `taken`, which replace columns of the same name. Rows repeated with one doc_id and text come as one, with what all of them
    take."""
    took = mix(docs, weights, most).groupBy("doc_id", "sub").agg(
        F.max("size").alias("size"), F.max("source_size").alias("source_size"),
        F.max("target").alias("target"), F.sum("taken").alias("taken"),
    ).where("taken > 0").select(*[F.col(c).alias(f"_m_{c}") for c in
                                  ("doc_id", "sub", "size", "source_size", "target", "taken")])
    keyed = docs.withColumn("_m_key", F.xxhash64("text")).dropDuplicates(["doc_id", "_m_key"])
    return keyed.join(
        took.hint("rebalance"),
        F.col("doc_id").cast("long").eqNullSafe(F.col("_m_doc_id")) & (F.col("_m_key") == F.col("_m_sub")),
    ).select(*[F.col(f"`{c}`") for c in docs.columns if c not in _ADDED], *[F.col(f"_m_{c}").alias(c) for c in _ADDED])
