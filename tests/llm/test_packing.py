"""Packing against encoding and packing each text plainly."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from public_tokenizers import path
from tokenizers import Tokenizer

from sentrymill.llm import packing, queries

FILE = path("byte_bpe_50k.json")
_PLAIN, _ENCODER = Tokenizer.from_file(FILE), packing.Encoder(FILE)


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(FILE)


def check(packed, rows, tokenizer, capacity):
    """All pieces of all rows are there, as they should be, and lie side by side."""
    want = Counter()
    for doc, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        first = len(ids) % capacity or min(len(ids), capacity)
        edges = [0, *range(first, len(ids) + 1, capacity)]
        for number, (a, b) in enumerate(zip(edges, edges[1:])):
            want[doc, number, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed) == want
    held = defaultdict(list)
    for r in packed:
        held[r.sequence_id].append((r.offset, r.length))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    total = sum(r.length for r in packed)
    return len(held), -(-total // capacity)


def many(odd_rows):
    rng = random.Random(3)
    rows = [(100 + i, " ".join(rng.choice(["word", "Été", "x1", "don't", "…", "日本", "<|endoftext|>"])
                               for _ in range(rng.randint(0, 700)))) for i in range(300)]
    return rows + odd_rows + [(5000 + i, "the same short text") for i in range(300)] + [rows[0]] * 40


@pytest.mark.parametrize("capacity", [64, 1024])
def test_pack(make_docs, odd_rows, tokenizer, capacity):
    rows = many(odd_rows)
    packed = packing.pack(make_docs(rows), FILE, capacity)
    got = packed.collect()
    used, least = check(got, rows, tokenizer, capacity)
    assert used <= least * 1.01 + 1
    assert all(zlib.crc32(bytes(r.ids)) == r.ids_crc32 for r in got)
    whole = packing.sequences(packed).collect()
    assert sum(len(r.ids) // 4 for r in whole) == sum(r.length for r in got)
    by_piece = Counter((r.doc_id, r.piece, bytes(r.ids)) for r in got)
    assert by_piece == Counter((p.doc_id, p.piece, bytes(r.ids[4 * p.offset:4 * (p.offset + p.length)]))
                               for r in whole for p in r.parts)


def test_empty(make_docs):
    packed = packing.pack(make_docs([]), FILE, ids=False)
    assert packed.count() == 0
    assert packed.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from(" \n\t\r\x0b\x0c\x1c\x1f\x85\xa0᠎​  　'sa1.é日<|>"),
                                  st.characters(codec="utf-8"))), max_size=6))
def test_encoder_gives_the_ids_of_the_tokenizer(texts):
    for text, raw in zip(texts, _ENCODER.encode(texts)):
        assert np.frombuffer(raw, "<u4").tolist() == _PLAIN.encode(text, add_special_tokens=False).ids


def lengths(kind):
    rng = np.random.default_rng(7)
    return {
        "even": rng.integers(1, 1025, 5000), "long": rng.integers(400, 1025, 5000), "short": rng.integers(1, 60, 5000),
        "one": np.full(1000, 300), "few": rng.choice([300, 350, 500, 20], 5000), "whole": np.full(10, 1024),
        "log": np.clip(np.exp(rng.normal(5.5, 1, 50_000)), 1, 1024).astype(int),
    }[kind]


@pytest.mark.parametrize("kind", ["even", "long", "short", "one", "few", "whole", "log"])
def test_plan(kind):
    sizes = lengths(kind)
    counts = Counter(sizes.tolist())
    shelves = packing.plan(counts)
    got = Counter()
    for shelf in shelves:
        assert sum(a * b for a, b in shelf.lengths) <= 1024
        for length, copies in shelf.lengths:
            got[length] += copies * shelf.times
    assert got == counts
    assert len(shelves) < 8 * 1024                   # follows the lengths, not the pieces
    bins = []                                        # best-fit decreasing, piece by piece
    for size in sorted(sizes[:2000].tolist(), reverse=True):
        fit = min((b for b in range(len(bins)) if bins[b] >= size), key=lambda b: bins[b], default=None)
        if fit is None:
            bins.append(1024 - size)
        else:
            bins[fit] -= size
    assert sum(s.times for s in packing.plan(Counter(sizes[:2000].tolist()))) <= len(bins)


def test_ten_times_the_pieces_need_no_more_shelves():
    counts = Counter(lengths("log").tolist())
    large = Counter({k: 1000 * v for k, v in counts.items()})
    assert len(packing.plan(large)) < 8 * 1024


def test_query_on_the_sample(spark, sample, tokenizer):
    got = queries.QUERIES["op12_packing"](spark, "/root/testdata/sf0.001").collect()
    rows = [(r.doc_id, r.text) for r in sample("documents").select("doc_id", "text").collect()]
    used, least = check(got, rows, tokenizer, 1024)
    assert used <= least + 2
