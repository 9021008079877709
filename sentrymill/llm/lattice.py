"""Near-duplicate vectors by E8 lattice hashing.

Each table projects unit vectors at random to a few blocks of eight numbers and decodes
every block to the nearest point of the E8 lattice. Vectors of one label meet where one's
cell is among the other's cell and its nearest neighbouring cells; every pair that meets
is verified by cosine in double precision. Equal vectors are one vector from the start,
so copies are never paired.
"""

from __future__ import annotations

from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentrymill.llm.common import component_ids, spread_join, stored

LEAST_COSINE = 0.98
TABLES = 8
BLOCKS = 2         # of eight dimensions in a key
PROBES = 3         # nearest lattice points looked up in each block, its own included
SCALE = 2.0        # unit vectors at cosine 0.98 are 0.57 apart in a block; lattice points 1.41
SEED = 11
_PIECE = 2048      # vectors worked on at a time


def _shortest() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    out = []
    for i, j in combinations(range(8), 2):
        for a, b in product((1, -1), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            out.append(v)
    out += [np.array(s) / 2 for s in product((1, -1), repeat=8) if np.prod(s) > 0]
    return np.array(out)


_NEAR = _shortest()


def _even(x: np.ndarray) -> np.ndarray:
    """Nearest whole-number points with even sum."""
    p = np.rint(x)
    off = x - p
    worst = np.abs(off).argmax(axis=1)
    rows = np.arange(len(x))
    turn = np.where(off[rows, worst] < 0, -1.0, 1.0)
    p[rows, worst] += np.where(p.sum(axis=1) % 2 != 0, turn, 0)
    return p


def nearest(x: np.ndarray) -> np.ndarray:
    """The nearest point of E8 to each row: of whole numbers with even sum, or of those
    moved by one half."""
    a, b = _even(x), _even(x - 0.5) + 0.5
    closer = ((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1)
    return np.where(closer[:, None], a, b)


def nearest_cells(x: np.ndarray, probes: int) -> np.ndarray:
    """The `probes` nearest lattice points: rows x probes x 8, the nearest first."""
    own = nearest(x)
    along = (x - own) @ _NEAR.T
    best = np.argpartition(-along, probes - 1, axis=1)[:, : probes - 1]
    return np.concatenate([own[:, None, :], own[:, None, :] + _NEAR[best]], axis=1)


def _cell_hash(points: np.ndarray) -> np.ndarray:
    """64-bit hashes of lattice points (last axis)."""
    twice = np.rint(2 * points).astype(np.int64).view(np.uint64)
    out = np.zeros(points.shape[:-1], np.uint64)
    with np.errstate(over="ignore"):
        for i in range(8):
            out = (out ^ twice[..., i]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
    return out


def projections(size: int, tables: int = TABLES, blocks: int = BLOCKS) -> np.ndarray:
    """Random orthonormal directions for each table, the same everywhere."""
    rng = np.random.default_rng([SEED, size])
    width = 8 * blocks
    out = []
    for _ in range(tables):
        square = rng.normal(size=(max(size, width), width))
        out.append(np.linalg.qr(square)[0][:size])
    return np.array(out)


def keys(unit: np.ndarray, probes: int, scale: float = SCALE, tables: int = TABLES, blocks: int = BLOCKS) -> np.ndarray:
    """Keys of unit vectors: rows x tables x probes ** blocks."""
    spread = scale * np.sqrt(unit.shape[1])
    out = []
    for number, basis in enumerate(projections(unit.shape[1], tables, blocks)):
        x = unit @ basis * spread / np.sqrt(8)
        total = np.full((len(unit), 1), np.uint64(number))
        for b in range(blocks):
            cells = _cell_hash(nearest_cells(x[:, 8 * b: 8 * b + 8], probes) if probes > 1 else nearest(x[:, 8 * b: 8 * b + 8])[:, None, :])
            with np.errstate(over="ignore"):
                total = ((total[:, :, None] * np.uint64(0xBF58476D1CE4E5B9)) ^ cells[:, None, :]).reshape(len(unit), -1)
        out.append(total)
    return np.stack(out, axis=1)


def _vectors(batch, column: int) -> np.ndarray:
    """Equally long lists as rows of doubles."""
    values = batch.column(column).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(batch.num_rows, -1)


def _by_length(batch, column: int):
    """A batch cut into pieces whose lists in `column` are equally long."""
    lengths = np.array([len(v) for v in batch.column(column).to_pylist()])
    for n in np.unique(lengths):
        part = batch.filter(pa.array(lengths == n))
        for at in range(0, part.num_rows, _PIECE):
            yield part.slice(at, _PIECE)


def lattice_keys(vectors: DataFrame, probes: int) -> DataFrame:
    """(`key`, `node`) rows of distinct vectors (`node`, `label`, `v`)."""
    def run(batches):
        for batch in batches:
            for part in _by_length(batch, 2):
                v = _vectors(part, 2)
                found = keys(v / np.linalg.norm(v, axis=1, keepdims=True), probes)
                apart = part.column(1).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                with np.errstate(over="ignore"):
                    apart = (apart + np.uint64(v.shape[1]) * np.uint64(0x632BE59BD9B4E019)) * np.uint64(0x9E3779B97F4A7C15)
                    found = (found ^ apart[:, None, None]).reshape(len(v), -1)
                node = np.repeat(part.column(0).to_numpy(zero_copy_only=False), found.shape[1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found.reshape(-1).view(np.int64)), pa.array(node)], ["key", "node"])

    return vectors.select("node", "label", "v").mapInArrow(run, "key long, node long")


def _close(least: float):
    def run(batches):
        for batch in batches:
            for part in _by_length(batch, 2):
                u, v = _vectors(part, 2), _vectors(part, 3)
                cosine = (u * v).sum(axis=1) / (np.sqrt((u * u).sum(axis=1)) * np.sqrt((v * v).sum(axis=1)))
                near = pa.array(cosine >= least)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).filter(near), part.column(1).filter(near), pa.array(cosine).filter(near)], ["a", "b", "cosine"])

    return run


def links(vectors: DataFrame, least: float = LEAST_COSINE) -> DataFrame:
    """Pairs (`a` < `b`) of distinct vectors of one label with their cosine, if it is at
    least `least`."""
    index = lattice_keys(vectors, 1).withColumnRenamed("node", "a")
    probe = lattice_keys(vectors, PROBES).withColumnRenamed("node", "b")
    met = index.join(probe, "key").where("a <> b").select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    one = vectors.select(F.col("node").alias("a"), F.col("label").alias("la"), F.col("v").alias("va"))
    two = vectors.select(F.col("node").alias("b"), F.col("label").alias("lb"), F.col("v").alias("vb"))
    return (
        spread_join(spread_join(met, one, ["a"]), two, ["b"])
        .where("la = lb and size(va) = size(vb)").select("a", "b", "va", "vb")
        .mapInArrow(_close(least), "a long, b long, cosine double")
    )


def near_duplicates(rows: DataFrame, least: float = LEAST_COSINE) -> DataFrame:
    """One row per input row: `vec_id`, `n_links`, `component_id`, `kept`.

    `n_links` counts the other vectors of the same label whose cosine is at least
    `least`; `component_id` is the smallest vec_id reachable by links; `kept` tells
    whether it is the vector's own. A vector that is null, empty or zero, or holds null
    or non-finite components, one without label or vec_id, and vectors of different
    lengths link with nothing. Equal vectors, repeated rows among them, link with each
    other. Extra columns are ignored. Starts jobs when called; distinct vectors and links
    are kept in the shared folder.
    """
    sound = (
        "vec_id is not null and label is not null and embedding is not null and size(embedding) > 0 "
        "and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) "
        "and exists(embedding, x -> x <> 0)"
    )
    held = rows.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
        F.col("embedding").cast("array<double>").alias("embedding"),
    ).withColumn("ok", F.coalesce(F.expr(sound), F.lit(False)))
    # 0.0 and -0.0 are equal and must hash alike
    keyed = stored(held.select(
        "vec_id", F.when(F.col("ok"), F.col("label")).alias("label"),
        F.when(F.col("ok"), F.expr("transform(embedding, x -> x + 0.0D)")).alias("v"),
    ).withColumns({
        "h1": F.when(F.col("v").isNotNull(), F.xxhash64("label", "v")),
        "h2": F.when(F.col("v").isNotNull(), F.xxhash64(F.lit(8), "v", "label")),
    }))
    # vectors are told apart by 128 bits and get a short number once they are written
    vectors = stored(keyed.where("h1 is not null").groupBy("h1", "h2").agg(
        F.first("label").alias("label"), F.first("v").alias("v"),
        F.min("vec_id").alias("least"), F.count("*").alias("copies"),
    ).withColumn("node", F.monotonically_increasing_id()))
    found = stored(links(vectors, least).select("a", "b"))
    ids = component_ids(vectors.select("node", "least"), found)
    both = found.unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b")))
    beyond = spread_join(both, vectors.select(F.col("node").alias("b"), "copies"), ["b"]).groupBy("a").agg(
        F.sum("copies").alias("more"))
    per = stored(
        vectors.select("h1", "h2", "node", "copies").join(ids, "node")
        .join(beyond.withColumnRenamed("a", "node"), "node", "left")
        .select("h1", "h2", "component_id", (F.col("copies") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"))
    )
    return keyed.join(per.hint("rebalance"), ["h1", "h2"], "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("component_id", "vec_id"), F.lit(False)).alias("kept"),
    )
