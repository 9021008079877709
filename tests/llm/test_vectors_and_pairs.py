"""Embeddings and preference pairs."""

import numpy as np
import pytest

from sentrymill.llm import lattice, preference


def slow_links(rows):
    ok = [r for r in rows if r[0] is not None and r[2] is not None and r[1] and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])]
    n = {id(r): 0 for r in rows}
    near = []
    for i, a in enumerate(ok):
        for b in ok[:i]:
            if a[2] == b[2] and len(a[1]) == len(b[1]):
                u, v = np.array(a[1], float), np.array(b[1], float)
                if u @ v / (np.linalg.norm(u) * np.linalg.norm(v)) >= 0.98:
                    near.append((a, b))
                    n[id(a)] += 1
                    n[id(b)] += 1
    least = {id(r): r[0] for r in rows}
    for _ in rows:
        for a, b in near:
            least[id(a)] = least[id(b)] = min(least[id(a)], least[id(b)])
    return [(r[0], n[id(r)], least[id(r)], r[0] is not None and least[id(r)] == r[0]) for r in rows]


def key(r):
    return tuple((v is None, v or 0) for v in r)


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(30, 64))
    rows = []
    for i in range(400):
        v = centres[rng.integers(30)]
        v = v + rng.normal(size=64) * rng.choice([0, 0.05, 0.13, 0.145, 0.3])
        rows.append((i, [float(np.float32(x)) for x in v], int(rng.integers(3))))
    rows += [(500, rows[0][1], rows[0][2]), (500, rows[0][1], rows[0][2]), (501, [0.0] * 64, 1), (502, None, 1), (503, [], 1),
             (504, [float("nan")] * 64, 1), (505, [None] + [1.0] * 63, 1), (506, rows[0][1], None), (None, rows[0][1], rows[0][2]),
             (507, [float("inf")] * 64, 1), (508, [1.0, 2.0], 0), (509, [2.0, 4.0], 0), (510, [-0.0, 1.0], 0), (511, [0.0, 1.0], 0), (512, [3.0], 0)]
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, label int, node string, a long")
    got = [tuple(r) for r in lattice.near_duplicates(table).collect()]
    assert sorted(got, key=key) == sorted(slow_links(rows), key=key)
    assert lattice.near_duplicates(table.limit(0)).count() == 0


def test_e8_decoder():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 8)) * 2
    p = lattice.nearest(x)
    d = ((x - p) ** 2).sum(axis=1)
    assert len(lattice._NEAR) == 240 and np.allclose((lattice._NEAR ** 2).sum(axis=1), 2)
    assert d.max() <= 1 + 1e-9                       # covering radius
    assert (((x - p)[:, None] - lattice._NEAR) ** 2).sum(axis=2).min(axis=1).min() >= 0
    assert ((((x - p)[:, None] - lattice._NEAR) ** 2).sum(axis=2).min(axis=1) >= d - 1e-9).all()


def test_recall_at_the_threshold():
    rng = np.random.default_rng(0)
    u = rng.normal(size=(5000, 64))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    w = rng.normal(size=u.shape)
    w -= (w * u).sum(axis=1, keepdims=True) * u
    v = 0.98 * u + np.sqrt(1 - 0.98**2) * w / np.linalg.norm(w, axis=1, keepdims=True)
    met = np.zeros(len(u), bool)
    for a, b in ((u, v), (v, u)):         # either may be the one that looks up
        met |= (lattice.keys(a, 1)[:, :, 0][:, :, None] == lattice.keys(b, lattice.PROBES)).any(axis=(1, 2))
    assert met.mean() > 0.9995


TURNS = "pair_id long, turn long, role string, text string, prompt string, n long"


def pairs(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], TURNS)


def test_pairs(spark):
    chosen = pairs(spark, [(1, 0, "user", "hi"), (1, 1, "assistant", "hello"), (1, 2, "user", "more"), (1, 3, "assistant", "yes"),
                           (2, 0, "user", "same"), (3, 0, "user", "only chosen"), (5, 0, "user", None), (5, 1, None, "t"),
                           (None, 0, "user", "no pair"), (6, 0, "user", "a"), (6, 1, "assistant", "b")])
    rejected = pairs(spark, [(1, 5, "user", "hi"), (1, 7, "assistant", "hello"), (1, 9, "user", "other"), (1, 11, "assistant", "no"),
                             (2, 0, "user", "same"), (4, 0, "assistant", "only rejected"), (5, 0, "user", ""), (6, 0, "user", "a")])
    got = {r.pair_id: r for r in preference.format_pairs(chosen, rejected).collect()}
    assert set(got) == {1, 2, 3, 4, 5, 6}
    r = got[1]
    assert r.n_prompt == 2 and r.prompt == "<|user|>\nhi<|end|>\n<|assistant|>\nhello<|end|>\n"
    assert r.chosen == "<|user|>\nmore<|end|>\n<|assistant|>\nyes<|end|>\n"
    assert [r.chosen[s.start:s.end] for s in r.chosen_spans] == ["yes<|end|>\n"]
    assert [r.rejected[s.start:s.end] for s in r.rejected_spans] == ["no<|end|>\n"]
    assert (got[2].n_prompt, got[2].chosen, got[2].rejected) == (1, "", "")
    assert got[3].n_prompt == 0 and got[3].rejected == "" and got[4].chosen == ""
    assert got[5].n_prompt == 1 and got[5].chosen == "<||>\nt<|end|>\n" and got[5].chosen_spans == []
    assert got[6].n_prompt == 1 and got[6].rejected == ""
    assert preference.format_pairs(chosen.limit(0), rejected.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["op3_substrings", "op5_licenses", "op6_lines", "op8_embeddings", "op9_preference", "op10_backoff"])
def test_queries_against_sql(spark, name):
    import oracle_check

    folder = "/root/testdata/sf0.001"
    assert oracle_check.difference(spark, oracle_check.connect(folder), name, folder) is None
