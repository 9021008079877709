"""Language-model scores by stupid backoff, with n-gram counts from all texts but one's own.

The count tables of all orders are kept by hash in parts; each block of texts joins its
exploded n-grams to them (see blocks.py) and adds up the logarithms of each document.
However frequent an n-gram is, it is one entry for a block. From trigrams on a block asks
only for n-grams whose two parts of one word less both occur in other documents: no other
document can hold the rest.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentrymill.llm import blocks
from sentrymill.llm.benchmark import mix
from sentrymill.llm.common import WORD

ORDER = 3                 # words of the longest n-gram
ALPHA = 0.4               # factor of a step back
BLOCK_CHARS = 8_000_000   # the larger a block, the more of its n-grams it has more than once


class Grams:
    """The n-grams of a block's texts. Of order k the n-gram that ends at each token, as a
    64-bit hash, and whether it lies inside its text. A-Z are taken in lower case."""

    def __init__(self, table: pa.Table, order: int):
        at, words, counts = blocks.word_codes(table.column("t"))
        one = blocks.hashed(at, [w.lower() for w in words])
        self.doc = np.repeat(np.arange(len(counts)), counts)
        self.place = np.arange(len(one)) - np.repeat(np.cumsum(counts) - counts, counts)
        self.copies = table.column("copies").to_numpy()[self.doc]
        self.hash = [one]
        for _ in range(1, order):
            longer = one.copy()
            longer[1:] = mix(self.hash[-1][:-1], one[1:])
            self.hash.append(longer)
        self.elsewhere: list[np.ndarray] = []

    def asked(self, k: int) -> np.ndarray:
        """Tokens whose n-gram of order k is asked for; from 3 on this needs elsewhere."""
        inside = self.place >= k - 1
        if k > 2:
            less = self.elsewhere[k - 2] > 0
            inside[1:] &= less[1:] & less[:-1]
        return inside

    def keys(self, k: int):
        mask = self.asked(k)
        return self.hash[k - 1][mask], None, self.copies[mask]

    def tell(self, answers: pa.Table, upto: int, parts: int) -> None:
        """Fill `elsewhere`: for each order how often the n-gram at a token occurs in other rows."""
        for k in range(1, upto + 1):
            mask = self.asked(k)
            mine = self.hash[k - 1][mask]
            _, which, n = np.unique(mix(mine, self.doc[mask].astype(np.uint64)), return_inverse=True, return_counts=True)
            other = np.zeros(len(mask), np.int64)
            other[mask] = blocks.told(answers, k, mine, None, parts) - (n[which] if len(which) else 0)
            self.elsewhere.append(other)


def _values(grams: Grams, words: int, order: int, alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """Score of every token and how many steps back it took."""
    own = np.bincount(grams.doc, minlength=1)[grams.doc] if len(grams.doc) else np.zeros(0, np.int64)
    value, found = np.full(len(own), 1 / max(words, 1)), np.zeros(len(own), np.int64)
    for k, other in enumerate(grams.elsewhere, 1):
        seen = np.flatnonzero(other > 0)
        below = (words - own)[seen] if k == 1 else grams.elsewhere[k - 2][seen - 1]
        value[seen], found[seen] = other[seen] / below, k
    steps = np.minimum(grams.place + 1, order) - found
    return value * alpha ** steps, steps


def score(docs: DataFrame, order: int = ORDER, alpha: float = ALPHA) -> DataFrame:
    """One row per input row: `doc_id`, `n_tokens`, `n_backed_off`, `log_score`, `mean_log`.

    Tokens are words with A-Z in lower case. Counts are those of all other rows, so a text
    is not judged by itself; all n-grams count, also those seen once. A token scores
    c(n-gram)/c(n-gram without it) of the longest n-gram of at most `order` words that ends
    with it, lies in its text and occurs in other rows; a single word scores c(word) by
    their tokens. Each word less is a step back and multiplies by `alpha`. A word of no
    other row is one more step back, to one in all tokens. `log_score` adds up the natural
    logarithms; `n_backed_off` counts tokens with a step back or more. Null and empty texts
    have no tokens, log_score 0 and a null mean. Repeated rows are rows of their own, each
    among the others of its copies; a block holds one of them with their number. A null
    doc_id is kept. Extra columns are ignored. When called it starts jobs that count
    characters and words and look for repeated rows.
    """
    if order < 1:
        raise ValueError("order is 1 or more")
    held = docs.agg(F.sum(F.length("text").cast("long")), F.sum(F.regexp_count("text", F.lit(WORD)).cast("long"))).first()
    chars, words = held[0] or 0, held[1] or 0
    parts = blocks.parts_for(docs, chars)
    dealt, names = blocks.deal(docs, chars, BLOCK_CHARS)

    def first_keys(table):
        grams = Grams(table, min(order, 2))
        return {k: grams.keys(k) for k in range(1, min(order, 2) + 1)}

    def ask_for(k):
        def ask(table, answers):
            if not table.num_rows:
                return blocks.ask_rows(0, {}, parts)
            grams = Grams(table, k)
            grams.tell(answers, k - 1, parts)
            return blocks.ask_rows(table.column("block")[0].as_py(), {k: grams.keys(k)}, parts)
        return ask

    def add_up(table, answers):
        grams = Grams(table, order)
        grams.tell(answers, order, parts)
        value, steps = _values(grams, words, order, alpha)
        n = table.num_rows
        columns = [np.bincount(grams.doc, minlength=n).astype(np.int64), np.bincount(grams.doc, steps > 0, n).astype(np.int64),
                   np.bincount(grams.doc, np.log(value), n).astype(np.float64)]
        return pa.Table.from_arrays(
            [*(table.column(c) for c in ("doc_id", "k1", "k2")), *map(pa.array, columns)],
            ["doc_id", "k1", "k2", "n_tokens", "n_backed_off", "log_score"])

    answers = blocks.totals(blocks.asks(dealt, first_keys, parts))
    for k in range(3, order + 1):
        answers = answers.unionByName(blocks.totals(blocks.with_answers(dealt, answers, ask_for(k), blocks._ASK)))
    scored = blocks.with_answers(
        dealt, answers, add_up, "doc_id long, k1 long, k2 long, n_tokens long, n_backed_off long, log_score double")
    return blocks.for_all(scored, names).select(
        "doc_id", "n_tokens", "n_backed_off", "log_score",
        F.when(F.col("n_tokens") > 0, F.col("log_score") / F.col("n_tokens")).alias("mean_log"))
