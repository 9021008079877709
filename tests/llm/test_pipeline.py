"""The pipeline's stages in turn, each against a plain account of its decision."""

import itertools
import re

import corpus_pipeline
from test_mixing import slow_targets
from test_text_passes import sha, slow_lines

from sentrymill.llm import benchmark, quality


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))}


def slow_kept(rows):
    """The smallest doc_id of each group of texts linked at a Jaccard similarity of 0.8."""
    sets, group = [shingles(t) for _, t in rows], list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
            old, new = group[j], group[i]
            group = [new if g == old else g for g in group]
    return sorted({min(d for (d, _), h in zip(rows, group) if h == g) for g in set(group)})


def test_stages_one_after_another(spark, sample):
    folder = "/root/testdata/sf0.001"
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "line_dedup", "simhash", "decontamination", "mixing"]
    stage = dict(corpus_pipeline.STAGES)
    docs = sample("documents")
    good = stage["quality"](spark, docs, folder).cache()
    bad = {r.doc_id for r in quality.score(docs, sample("labels")).where("predicted = 0").collect()}
    assert good.columns == docs.columns and ids(good) == sorted(set(ids(docs)) - bad)

    cut = stage["line_dedup"](spark, good, folder).cache()
    rows = [(r.doc_id, r.text) for r in good.collect()]
    want = {d: h for d, _, _, h in slow_lines(rows)}
    assert cut.columns == docs.columns and {r.doc_id: sha(r.text) for r in cut.collect()} == want
    assert all(r.n_chars == len(r.text) for r in cut.collect())

    one = stage["simhash"](spark, cut, folder).cache()
    assert one.columns == docs.columns and ids(one) == slow_kept([(r.doc_id, r.text) for r in cut.collect()])

    clean = stage["decontamination"](spark, one, folder).cache()
    leaked = {r.doc_id for r in benchmark.contaminated(one, sample("benchmark")).collect()}
    assert clean.columns == docs.columns and ids(clean) == sorted(set(ids(one)) - leaked)
    items = [r.text for r in sample("benchmark").collect()]
    assert not any(t in r.text for r in clean.collect() for t in items)

    mixed = stage["mixing"](spark, clean, folder).collect()
    sizes = {}
    for r in clean.collect():
        sizes[r.source] = sizes.get(r.source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
    want = slow_targets(sizes)
    taken = {s: sum(r.taken for r in mixed if r.source == s) for s in sizes}
    assert all(r.taken > 0 for r in mixed)
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(100, 0.2 * t)


def test_run_gives_the_last_stage(spark):
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert {"doc_id", "text", "lang", "source", "n_chars", "size", "target", "taken"} <= set(rows.columns)
    assert rows.count() > 50


def test_no_documents(spark, make_docs, tmp_path):
    empty = make_docs([]).select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, empty, "/root/testdata/sf0.001")
        assert out.count() == 0


def test_rows_are_judged_by_their_own_text(spark, make_docs, sample):
    """Texts that share a doc_id, or have none, are judged one by one in every stage."""
    item = sample("benchmark").first().text
    plain = [f"{i} plain words about nothing {i} in particular number {i}" for i in range(3)]
    rows = [(1, plain[0]), (1, item), (1, plain[1]), (None, item), (None, plain[2]), (2, plain[1]), (3, None)]
    docs = make_docs(rows).select("doc_id", "text", "lang", "source", "n_chars")
    stage = dict(corpus_pipeline.STAGES)
    near = [(r.doc_id, r.text) for r in stage["simhash"](spark, docs, "/root/testdata/sf0.001").collect()]
    assert sorted(near, key=str) == sorted([(1, plain[0]), (1, item), (1, plain[1]), (None, plain[2]), (3, None)], key=str)
    left = [(r.doc_id, r.text) for r in stage["decontamination"](spark, docs, "/root/testdata/sf0.001").collect()]
    assert sorted(left, key=str) == sorted([r for r in rows if r[1] != item], key=str)
    good = {(r.doc_id, r.text) for r in stage["quality"](spark, docs, "/root/testdata/sf0.001").collect()}
    alike = [{d for d, t in good if t == text} for text in (plain[1], item)]
    assert all(a in (set(), {d for d, t in rows if t == text}) for a, text in zip(alike, (plain[1], item)))
