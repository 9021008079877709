"""Quality scores: random-indexing word vectors, pooled per document, then a two-layer
network whose probabilities are calibrated by a temperature.

Every word and every word shape falls into one of ROWS hash buckets, which has a sparse
random index vector given by its number. The context vector of a bucket is the sum of the
index vectors of its neighbours in all texts: whole numbers, so the sum does not depend
on the order of tasks, in a table whose size is fixed and can be sent to every task.
A document's features are the mean context and index vectors of its words, and how
evenly its words are spread.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentrymill.llm.blocks import word_codes
from sentrymill.llm.common import Memo, stored, texts_or_empty

ROWS = 1 << 13          # buckets of words; fixed, whatever the vocabulary
WIDTH = 32              # of index and context vectors
NONZERO = 4             # of an index vector, half of them -1
WINDOW = 2              # neighbours on each side
SAMPLE = 20_000         # most labelled rows the network is fitted on
HIDDEN = 24
EPOCHS = 300
FEATURES = 2 * WIDTH + 4
SEED = 7


def index_vectors() -> np.ndarray:
    """The random index vectors of all buckets, the same everywhere."""
    rng = np.random.default_rng(SEED)
    out = np.zeros((ROWS, WIDTH), np.float32)
    for row in out:
        at = rng.choice(WIDTH, NONZERO, replace=False)
        row[at[: NONZERO // 2]], row[at[NONZERO // 2:]] = 1, -1
    return out


def _shape(word: bytes) -> bytes:
    """What kind of word it is: case, digits, marks at its end."""
    text = word.decode("utf-8", "replace")
    core = text.rstrip(".,;:!?")
    kind = ("U" if core.isupper() and len(core) > 1 else "T" if core[:1].isupper() else
            "L" if core.islower() else "D" if any(c.isdigit() for c in core) else "-")
    marks = "".join(sorted({c for c in text if not c.isalnum()}))[:4]
    return f"\0{kind}{marks}".encode()


def _pair(word: bytes) -> int:
    """Bucket of a word and bucket of its shape, as one number."""
    return zlib.crc32(word.lower()) % ROWS * ROWS + zlib.crc32(_shape(word)) % ROWS


def _buckets(texts: pa.Array, pairs: Memo) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word buckets and shape buckets of all words of `texts` in order, and the number of
    words in each text. `pairs` remembers the buckets of words met before."""
    at, known, counts = word_codes(texts)
    both = np.array([pairs[w] for w in known] or [0], np.int64)[at]
    return both // ROWS, both % ROWS, counts


def _pieces(batches):
    """Batches cut so that each piece has about a million bytes of text, or one text."""
    for batch in batches:
        sizes = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False)) // (1 << 20)
        cuts = np.flatnonzero(np.diff(sizes)) + 1 if len(sizes) else []
        for start, end in zip([0, *cuts], [*cuts, batch.num_rows]):
            if end > start:
                yield batch.slice(start, end - start)


def context_vectors(docs: DataFrame) -> np.ndarray:
    """Context vectors of all buckets over every text: ROWS x WIDTH whole numbers.

    Each task adds up its texts and gives one row for each bucket it met; the sums of
    all tasks, ROWS rows at most, come to the driver.
    """
    index = index_vectors()

    def run(batches):
        pairs = Memo(_pair)
        total = np.zeros((ROWS, WIDTH), np.float64)
        met = False
        for batch in _pieces(batches):
            words, shapes, counts = _buckets(batch.column(1), pairs)
            if not len(words):
                continue
            met = True
            doc = np.repeat(np.arange(len(counts)), counts)
            for chain in (words, shapes):
                vectors, near = index[chain], np.zeros((len(chain), WIDTH), np.float32)
                for step in range(1, WINDOW + 1):
                    same = (doc[step:] == doc[:-step])[:, None]
                    near[:-step] += vectors[step:] * same
                    near[step:] += vectors[:-step] * same
                for axis in range(WIDTH):
                    total[:, axis] += np.bincount(chain, near[:, axis], ROWS)
        if met:
            rows = np.flatnonzero(total.any(axis=1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows), pa.array(total[rows].astype(np.int64).tolist(), pa.list_(pa.int64()))],
                ["bucket", "v"])

    parts = docs.select(F.lit(0).alias("k"), texts_or_empty().alias("t")).mapInArrow(
        run, "bucket long, v array<bigint>")
    summed = parts.groupBy("bucket").agg(*[F.sum(F.col("v")[i]).alias(f"v{i}") for i in range(WIDTH)])
    out = np.zeros((ROWS, WIDTH))
    for row in summed.collect():      # ROWS rows at most
        out[row[0]] = row[1:]
    return out


def features(docs: DataFrame, contexts: np.ndarray) -> DataFrame:
    """`doc_id`, `sub` (hash of the text) and `x`, the pooled vector of each row's whole text."""
    index = index_vectors()
    norms = np.linalg.norm(contexts, axis=1, keepdims=True)
    table = np.hstack([contexts / np.maximum(norms, 1), index / np.sqrt(NONZERO)]).astype(np.float32)

    def run(batches):
        pairs_of = Memo(_pair)
        for batch in _pieces(batches):
            words, shapes, counts = _buckets(batch.column(1), pairs_of)
            n, ends = len(counts), np.cumsum(counts)
            doc = np.repeat(np.arange(n), counts)
            x = np.zeros((n, FEATURES), np.float32)
            held = np.maximum(counts, 1)[:, None]
            for axis in range(WIDTH):       # words pool their contexts, shapes their index
                x[:, axis] = np.bincount(doc, table[words, axis], n)
                x[:, WIDTH + axis] = np.bincount(doc, table[shapes, WIDTH + axis], n)
            x[:, : 2 * WIDTH] /= held
            pairs = np.unique(doc * ROWS + words) if len(doc) else np.zeros(0, np.int64)
            x[:, -4] = np.bincount(pairs // ROWS, minlength=n)[:n] / held[:, 0]
            x[:, -3] = np.log1p(counts)
            same = (words[1:] == words[:-1]) & (doc[1:] == doc[:-1])
            x[:, -2] = np.bincount(doc[1:][same], minlength=n)[:n] / held[:, 0]
            sizes = pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False)
            x[:, -1] = np.log1p(sizes / held[:, 0])
            del ends
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(x.tolist(), pa.list_(pa.float32()))], ["doc_id", "sub", "x"])

    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), texts_or_empty().alias("t"), F.xxhash64("text").alias("sub")
    ).mapInArrow(run, "doc_id long, sub long, x array<float>")


def fold(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 3. Fold 1 is held out; a null id has no fold."""
    return F.crc32(F.col(doc_id).cast("long").cast("string").cast("binary")) % 3


class Network:
    """Two layers, tanh and logistic, fitted in full batches by Adam from a fixed seed;
    then one temperature for its logits from rows it was not fitted on."""

    def __init__(self, x: np.ndarray, y: np.ndarray, spare: np.ndarray):
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
        fit = ~spare if (~spare).any() else np.ones(len(y), bool)
        rng = np.random.default_rng(SEED)
        w1 = rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN))
        w = [w1, np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
        self.w, self.temperature = w, 1.0
        z, t = (x[fit] - self.mean) / self.scale, y[fit]
        m1, m2 = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w]
        for step in range(1, EPOCHS + 1):
            h = np.tanh(z @ w[0] + w[1])
            p = 1 / (1 + np.exp(-np.clip(h @ w[2] + w[3], -30, 30)))
            d = (p - t) / len(t)
            back = d[:, None] * w[2] * (1 - h * h)
            grads = [z.T @ back + 1e-4 * w[0], back.sum(0), h.T @ d + 1e-4 * w[2], np.array([d.sum()])]
            for a, g, u, v in zip(w, grads, m1, m2):
                u += 0.1 * (g - u)
                v += 0.01 * (g * g - v)
                a -= 0.02 * (u / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        if spare.any() and (~spare).any():
            logits, t = self.logits(x[spare]), y[spare]
            grid = np.exp(np.linspace(np.log(0.25), np.log(8), 60))
            loss = [np.mean(np.logaddexp(0, logits / g) - t * logits / g) for g in grid]
            self.temperature = float(grid[int(np.argmin(loss))])

    def logits(self, x: np.ndarray) -> np.ndarray:
        h = np.tanh((x - self.mean) / self.scale @ self.w[0] + self.w[1])
        return h @ self.w[2] + self.w[3]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -500, 500)))


def train(pooled: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Network | None:
    """Fit on at most `sample` labelled rows outside fold 1, those with the smallest hash
    of their id. A document labelled in several rows takes the majority, and a tie is
    left out. None if there is nothing to learn from."""
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("q"))
        .where("doc_id is not null and q is not null").where(fold() != 1)
        .groupBy("doc_id").agg(F.avg("q").alias("q")).where("q <> 0.5")
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    )
    pairs = pooled.join(known, "doc_id").groupBy("doc_id").agg(
        F.min("x").alias("x"), F.first("q").alias("q")).orderBy("doc_id").collect()   # `sample` rows at most
    if not pairs:
        return None
    x = np.array([r["x"] for r in pairs], np.float64)
    y = np.array([r["q"] > 0.5 for r in pairs], np.float64)
    spare = np.array([zlib.crc32(b"spare%d" % r["doc_id"]) % 5 == 0 for r in pairs])
    return Network(x, y, spare)


def _scored(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """`doc_id`, `sub` and `score` of every row."""
    pooled = stored(features(docs, context_vectors(docs)))
    model = train(pooled, labels, sample)

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            x = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(n, FEATURES)
            p = model(x.astype(np.float64)) if model and n else np.full(n, 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p)], ["doc_id", "sub", "score"])

    return pooled.mapInArrow(run, "doc_id long, sub long, score double")


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """One row per input row: `doc_id`, `held_out`, `score`, `predicted`.

    `score` is the probability of label 1 from the whole text alone; null and empty texts
    are scored as texts without words. `held_out` tells whether the id's fold is 1, whose
    labels are never learnt from; a null id is not held out. Without usable labels every
    score is 0.5. Repeated rows are scored alike; other columns are ignored. Starts jobs
    when called; pooled vectors are kept in the shared folder.
    """
    return _scored(docs, labels, sample).select(
        "doc_id", F.coalesce(fold() == 1, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """`docs` without the rows whose score is below 0.5. A row is judged by its own text, also
    where its doc_id is null or comes with other texts too."""
    bad = _scored(docs, labels, sample).where("score < 0.5").select(
        F.col("doc_id").alias("_bad"), F.col("sub").alias("_bad_text")).distinct()
    return docs.join(bad.hint("rebalance"), F.col("doc_id").cast("long").eqNullSafe(F.col("_bad"))
                     & (F.xxhash64("text") == F.col("_bad_text")), "left_anti")
