"""Lines, long repeats, licences, benchmark passages and language-model scores."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from sentrymill.llm import backoff, benchmark, blocks, licenses, lines, recompress

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def slow_lines(rows):
    strip = " \t\n\x0b\x0c\r"
    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(strip))
    held = collections.defaultdict(set)
    for doc, text in rows:
        if doc is not None:
            for line in (text or "").split("\n"):
                if len(key(line)) >= 40:
                    held[key(line)].add(doc)
    hot = {k: max(v) for k, v in held.items() if len(v) >= 5}
    out = []
    for doc, text in rows:
        split = (text or "").split("\n")
        kept = [x for x in split if doc is None or hot.get(key(x), doc) == doc]
        out.append((doc, len(split), len(split) - len(kept), sha("\n".join(kept))))
    return out


def line_rows(odd_rows):
    rng, hot = random.Random(2), ["A line that MANY documents hold, number %d, café" % i for i in range(4)]
    rows = [(i, "\n".join(rng.choice([f"  {rng.choice(hot)}\t", f"a line of its own, {i}, and long enough to count", "short"])
                          for _ in range(rng.randint(1, 9)))) for i in range(100, 300)]
    return rows + odd_rows + [(150, hot[0]), (None, hot[0])]


@pytest.mark.parametrize("per_part", [10, 2_000_000])
def test_lines(make_docs, odd_rows, monkeypatch, per_part):
    monkeypatch.setattr(lines, "ROWS_PER_PART", per_part)
    rows = line_rows(odd_rows)
    done = lines.dedup_lines(make_docs(rows)).collect()
    got = [(r.doc_id, r._n_lines, r._n_dropped, sha(r.text)) for r in done]
    key = lambda r: tuple((v is None, v or 0) for v in r)
    assert sorted(got, key=key) == sorted(slow_lines(rows), key=key)
    assert sum(r[2] for r in got) > 100
    assert lines.dedup_lines(make_docs([])).count() == 0


def slow_repeats(rows, width):
    split = [WORD.findall(t or "") for _, t in rows]
    seen = collections.Counter(tuple(w[i:i + width]) for w in split for i in range(len(w) - width + 1))
    out = []
    for (doc, _), w in zip(rows, split):
        gone = set()
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i:i + width])] > 1:
                gone.update(range(i, i + width))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out.append((doc, len(w), len(gone), sha(" ".join(kept))))
    return out


def test_repeats(make_docs, odd_rows):
    rng = random.Random(4)
    word = lambda: rng.choice("abcdefgh") * rng.randint(1, 3)
    passage = [word() for _ in range(80)]
    rows = []
    for i in range(20, 80):
        own, a, b = [word() for _ in range(rng.randint(0, 90))], rng.randint(0, 45), rng.randint(34, 80)
        rows.append((i, " ".join(own[:30] + passage[a:b] + own[30:])))
    rows += odd_rows + [(90, "a b " * 40), (91, "x y z " * 12), (92, " ".join(passage[:35]))]
    got = [tuple(r) for r in recompress.remove_repeats(make_docs(rows), texts=False).collect()]
    key = lambda r: tuple((v is None, v or 0) for v in r)
    assert sorted(got, key=key) == sorted(slow_repeats(rows, 35), key=key)
    assert recompress.remove_repeats(make_docs([])).count() == 0


def test_equal_windows_have_equal_anchors():
    rng = random.Random(8)
    texts = [" ".join(rng.choice("ab") for _ in range(rng.randint(0, 300))).encode() for _ in range(60)]
    for width in (5, 9, 35):
        words, counts = recompress.word_hashes(pa.array([t.decode() for t in texts]))
        key, text, first, last, _ = recompress.anchors(words, counts, width)
        assert (last - first + 1).sum() == np.maximum(counts - width + 1, 0).sum()
        of, begin = {}, np.cumsum(counts) - counts
        for k, t, a, b in zip(key.tolist(), text, first, last):
            for p in range(a, b + 1):
                window = words[begin[t] + p: begin[t] + p + width].tobytes()
                assert of.setdefault(window, k) == k


def test_licences(make_docs, odd_rows):
    mit = ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
           "associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
           "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
           "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
           "following conditions:\n\nThe above copyright notice and this permission notice shall be included in all "
           "copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF "
           "ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR "
           "A PARTICULAR PURPOSE AND NONINFRINGEMENT.")
    halves = mit.split("\n\n")
    rows = odd_rows + [
        (50, "Some text. Released under the MIT License. More text."), (51, mit), (52, mit.replace("documentation files", "documentation\nfiles")),
        (53, "\n".join([halves[2], halves[1], halves[0]])),          # wrong order
        (54, "Licensed under the Apache License, Version 2.0.\nLicensed under CC BY-NC 4.0."),
        (55, "It is not licensed under anything, by permission."), (56, "RELEASED UNDER THE MIT LICENSE"), (57, "Released under\nthe MIT\nLicense"),
    ]
    got = collections.defaultdict(list)
    for r in licenses.recognise(make_docs(rows)).collect():
        got[r.doc_id].append(r.licence)
    assert {k: sorted(v) for k, v in got.items()} == {
        50: ["MIT"], 51: ["MIT"], 52: ["MIT"], 54: ["Apache-2.0", "CC-BY-NC-4.0"], 56: ["MIT"], 57: ["MIT"]}
    assert licenses.recognise(make_docs([])).count() == 0
    assert all(any(s in x for s in licenses.STEMS) for x in licenses.SENTENCES.values())
    used = {i for _, ids in licenses.RULES for i in ids}
    assert used | {i for two in licenses.TOGETHER for i in two} == (
        set(licenses.SENTENCES) | set(licenses.TOGETHER.values()) | {f"notice {n}" for n in licenses.NAMES})
    assert all(re.sub("[^a-z0-9]+", " ", s).strip() == s for s in licenses.SENTENCES.values())


def test_licences_at_their_usual_width(make_docs):
    mit = """MIT License

Copyright (c) 2024 Someone

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM."""
    gpl = """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version.
#
# This program is distributed in the hope that it will be useful,
# but WITHOUT ANY WARRANTY; without even the implied warranty of
# MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
# GNU General Public License for more details."""
    rows = [
        (1, mit), (2, gpl), (3, mit.replace(" ", "\n")), (4, mit.replace("merge", "merge files")),
        (5, mit.replace("Permission is", "All permission is")),      # does not begin with a piece
        (6, mit.replace("NONINFRINGEMENT.", "NONINFRINGEMENT of rights.")),  # does not end with one
        (7, "the\n" * 2000 + gpl + "\nthis " + "x" * 50_000),
    ]
    got = {r.doc_id: (r.licence, r.sequence) for r in licenses.recognise(make_docs(rows)).collect()}
    whole = "mit_grant,mit_grant_and_notice,mit_notice,as_is"
    assert got == {1: ("MIT", whole), 2: ("GPL-3.0", "gpl_redistribute,gpl_no_warranty"), 3: ("MIT", whole),
                   7: ("GPL-3.0", "gpl_redistribute,gpl_no_warranty")}


BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided
that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution."""
THIRD = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
products derived from this software without specific prior written permission."""


def gnu(what, kind, version):
    return (f"This {what} is free software; you can redistribute it and/or modify it\nunder the terms of the GNU {kind} as "
            f"published by the\nFree Software Foundation; either version {version} of the License, or (at your option)\nany later "
            f"version.\n\nThis {what} is distributed in the hope that it will be useful, but WITHOUT\nANY WARRANTY; without even "
            f"the implied warranty of MERCHANTABILITY or FITNESS FOR A\nPARTICULAR PURPOSE. See the License.")


def test_licences_by_family_and_notice(make_docs):
    unnumbered = lambda t: re.sub(r"(?m)^\d\. ", "* ", t)
    isc = ("Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby "
           "granted, provided that the above\ncopyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE "
           "IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH\nREGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED "
           "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT")
    want = {
        1: (unnumbered(BSD), {"BSD-2-Clause"}), 2: (unnumbered(BSD + THIRD), {"BSD-3-Clause"}),
        3: (unnumbered(BSD + "\n\n" + BSD + THIRD), {"BSD-2-Clause", "BSD-3-Clause"}),
        4: (gnu("program", "General Public License", 2), {"GPL-2.0"}), 5: (gnu("library", "Lesser General Public License", "2.1"), {"LGPL-2.1"}),
        6: (gnu("program", "Lesser General Public License", 3), {"LGPL-3.0"}), 7: (gnu("program", "Affero General Public License", 3), {"AGPL-3.0"}),
        8: ("This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy", {"MPL-2.0"}),
        9: (isc, {"ISC"}), 10: ("This is free and unencumbered software released into the public domain.", {"Unlicense"}),
        11: ("This file is licensed under the MIT License.", {"MIT"}), 12: ("Intro. Released under the MIT License, see the file.", {"MIT"}),
        13: ("Distributed\nunder the\nMIT License", {"MIT"}), 14: ("This project is available under the terms of the BSD 3-Clause License (see LICENSE).", {"BSD-3-Clause"}),
        15: ("Code licensed under the MIT License", set()), 16: ("Released under the MIT Licensed terms", set()),
        17: ("SPDX-License-Identifier: MPL-2.0", {"MPL-2.0"}), 18: ("Licensed under CC BY-SA 4.0 by someone", {"CC-BY-SA-4.0"}),
    }
    got = collections.defaultdict(set)
    for r in licenses.recognise(make_docs([(i, t) for i, (t, _) in want.items()])).collect():
        got[r.doc_id].add(r.licence)
    assert {i: got[i] for i in want} == {i: w for i, (_, w) in want.items()}


def test_native_operators_run_no_python(make_docs, odd_rows, sample):
    from sentrymill.llm import preference
    turns = sample("conversations")
    for df in (licenses.recognise(make_docs(odd_rows)), preference.format_pairs(turns, preference.stale_replies(turns), "conv_id")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


def test_benchmark_passages(spark, make_docs, odd_rows):
    items = spark.createDataFrame([
        (1, "A train leaves Paris at 9 km per hour with Anna and 12 friends; how far does Anna ride before noon comes around again"),
        (2, "completely different words about gardens and rivers that nobody in this set will repeat at all today"),
        (3, "short item here"), (4, None), (5, ""), (2, "completely different words about gardens and rivers that nobody in this set will repeat at all today"),
    ], "item_id long, text string")
    base = "A train leaves {c} at {n} km per hour with {p} and {m} friends; how far does {q} ride before noon comes around again"
    say = lambda c="Paris", n=9, p="Anna", m=12, q=None: base.format(c=c, n=n, p=p, m=m, q=q or p)
    rows = odd_rows + [
        (20, "Filler words come first. " + say()), (21, "x " + say("Rome", 70, "Otto", 5) + " y"),
        (22, say("Rome", 70, "Otto", 5, "Berta")), (23, say().upper()), (24, "train leaves at noon with friends"),
        (25, "this is a short item here indeed"), (26, None), (27, "gardens and rivers that nobody in this set will"),
        (None, say()),
    ]
    got = {(r.doc_id, r.item_id): r for r in benchmark.contaminated(make_docs(rows), items).collect()}
    assert set(got) == {(20, 1), (21, 1), (22, 1), (23, 1), (25, 3), (27, 2), (None, 1)}   # 27: 9 of 16 tokens
    assert got[21, 1].reparameterised and not got[20, 1].reparameterised and got[20, 1].share == 1.0
    kept = {r.doc_id for r in benchmark.drop_contaminated(make_docs(rows), items).collect()}
    assert not {20, 21, 22, 23, 25} & kept and {24, 26, None} <= kept
    assert benchmark.contaminated(make_docs([]), items).count() == 0
    assert benchmark.contaminated(make_docs(rows), items.limit(0)).count() == 0


def test_slots_must_agree():
    good, plain, changed = benchmark.agreeing([(0, [1, 2], [7, 8]), (1, [2, 1], [8, 7]), (2, [1], [9])])
    assert good == {0, 1} and changed and plain == set()
    assert benchmark.agreeing([(0, [1, 2], [7, 7])])[0] == {0}        # two values may become one
    assert benchmark.agreeing([(0, [1, 1], [7, 8])])[0] == set()      # one value cannot become two
    assert benchmark.agreeing([(0, [], [])]) == ({0}, {0}, False)


def test_benchmark_beyond_the_filter_is_the_same(sample, monkeypatch):
    docs, items = sample("documents"), sample("benchmark")
    one = sorted(map(tuple, benchmark.contaminated(docs, items).collect()))
    monkeypatch.setattr(benchmark, "SENT_HASHES", 10)
    assert one and one == sorted(map(tuple, benchmark.contaminated(docs, items).collect()))
    texts = {r.item_id: r.text for r in items.collect()}
    plain = {(d.doc_id, i) for d in docs.collect() for i, t in texts.items() if t in d.text}
    assert plain <= {r[:2] for r in one}


def slow_scores(rows, order):
    split = [tuple(WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))) for _, t in rows]
    spans = lambda w: [w[i:i + k] for k in range(1, order + 1) for i in range(len(w) - k + 1)]
    every = collections.Counter(g for w in split for g in spans(w))
    total = sum(map(len, split))
    out = []
    for (doc, _), w in zip(rows, split):
        other, score, back = every.copy(), 0.0, 0
        other.subtract(spans(w))
        for i in range(len(w)):
            longest = min(order, i + 1)
            k = next((k for k in range(longest, 0, -1) if other[w[i + 1 - k:i + 1]]), 0)
            below = other[w[i + 1 - k:i]] if k > 1 else total - len(w) if k else total
            back += k < longest
            score += math.log((other[w[i + 1 - k:i + 1]] if k else 1) / below * 0.4 ** (longest - k))
        out.append((doc, len(w), back, round(score, 6)))
    return out


def test_repeated_rows_of_passages_fill_no_block(make_docs, monkeypatch):
    """Half of the table is one row with a passage: one row of a block, every copy loses it."""
    monkeypatch.setattr(blocks, "BLOCK_CHARS", 2_000)
    seen = []
    asks = blocks.asks
    monkeypatch.setattr(blocks, "asks", lambda dealt, *more: (seen.extend(dealt.groupBy("block").count().collect()), asks(dealt, *more))[1])
    long = " ".join(f"w{i}" for i in range(40))
    rows = [(i, f"some words of text number {i}") for i in range(200)] + [(7, long)] * 200 + [(8, long + " more")] + [(9, None)] * 3
    got = recompress.remove_repeats(make_docs(rows)).collect()
    assert len(got) == len(rows)
    assert {(r.doc_id, r.n_words, r.n_removed, r.kept) for r in got if r.n_words > 6 or r.doc_id == 9 and not r.n_words} == {
        (7, 40, 40, ""), (8, 41, 40, "more"), (9, 0, 0, "")}
    assert sum(r["count"] for r in seen) == 203 and max(r["count"] for r in seen) < 100
    single = recompress.remove_repeats(make_docs([(7, long)])).first()
    assert (single.n_removed, single.kept) == (0, long)


@pytest.mark.parametrize("block, order", [(300, 3), (2_000_000, 3), (300, 1), (300, 2), (5_000, 4)])
def test_scores(make_docs, odd_rows, monkeypatch, block, order):
    monkeypatch.setattr(backoff, "BLOCK_CHARS", block)
    short = [(d, " ".join(t.split(" ")[:3000])) if t else (d, t) for d, t in odd_rows]
    rows = short + [(100 + i, "the cat sat on the mat and The dog " * (i % 4) + f"n{i} alone") for i in range(30)]
    for given in (rows, [r for i, r in enumerate(rows) if r not in rows[:i]]):       # with and without repeated rows
        got = backoff.score(make_docs(given), order).collect()
        key = lambda r: tuple((v is None, v or 0) for v in r)
        mine = sorted([(r.doc_id, r.n_tokens, r.n_backed_off, round(r.log_score, 6)) for r in got], key=key)
        for a, b in zip(mine, sorted(slow_scores(given, order), key=key), strict=True):
            assert a[:3] == b[:3] and a[3] == pytest.approx(b[3], abs=1e-5, rel=1e-9)
        assert all((r.mean_log is None) == (r.n_tokens == 0) for r in got)


def test_scores_of_nothing_and_of_one_row(make_docs):
    assert backoff.score(make_docs([])).count() == 0
    alone = backoff.score(make_docs([(1, "a b a")])).first()
    assert alone.n_backed_off == 3 and alone.log_score == pytest.approx(math.log(0.4 ** 6 / 27))
    with pytest.raises(ValueError):
        backoff.score(make_docs([]), 0)


def test_repeated_rows_fill_no_block(make_docs, monkeypatch):
    """Half of the table is one row: it is one row of a block."""
    monkeypatch.setattr(backoff, "BLOCK_CHARS", 2_000)
    seen = []
    asks = blocks.asks
    monkeypatch.setattr(blocks, "asks", lambda dealt, *more: (seen.extend(dealt.groupBy("block").count().collect()), asks(dealt, *more))[1])
    rows = [(i, f"some words of text number {i}") for i in range(300)] + [(7, "one row sent again and again")] * 300
    got = backoff.score(make_docs(rows)).collect()
    assert len(got) == 600 and len({r.log_score for r in got if r.doc_id == 7}) == 2
    sizes = [r["count"] for r in seen]
    assert sum(sizes) == 301 and max(sizes) < 100
