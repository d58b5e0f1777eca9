import itertools
import random

import numpy as np
import pytest

from papyra.llm import ngram_join as nj
from papyra.llm.components import Forest, components


def grams(text, n):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({b" ".join(w)} if w else set())


def least_ids(rows, like):
    sets = [grams(t, like.words) for _, t in rows]
    f = Forest()
    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if sets[i] and sets[j] and like.whole * both >= like.part * len(sets[i] | sets[j]):
            f.link(i, j)
    out = []
    for i, (k, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if f.root(j) == f.root(i) and rows[j][0] is not None]
        out.append((k, len(sets[i]), min(ids) if ids and sets[i] else k))
    return sorted(out, key=str)


def _rows(seed=5, near=True):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    rows = [(0, None), (1, ""), (2, "One"), (3, "one"), (4, "one two"), (5, "\t \n"), (None, "alone in here"), (None, "ONE")]
    for group in range(12):
        base = [r.choice(words) for _ in range(r.choice((4, 9, 30, 120, 400)))]
        for copy in range(r.choice((1, 2, 5, 9))):
            w = list(base)
            for _ in range(r.choice((0, 0, 1, 2, 5)) if near else 0):
                w[r.randrange(len(w))] = r.choice(words)
            rows.append((100 + group * 20 + copy, " ".join(w)))
    rows += [(500 + i, " ".join(["the", "same", "line", "of", "text"] * 3 + [r.choice(words) for _ in range(40)])) for i in range(20)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("like", [nj.CONTRACT, nj.NEAR])
def test_same_as_brute_force(spark, like):
    rows = _rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as key", "1 as component_id", "2 as n")
    assert sorted(map(tuple, nj.joined(docs, like=like).collect()), key=str) == least_ids(rows, like)


def test_large_groups_of_near_copies_are_cut_into_blocks(spark):
    r = random.Random(1)
    base = [f"v{i}" for i in range(60)]
    rows = [(i, " ".join(base[:k] + [f"x{i}"] + base[k + 1 :])) for i, k in enumerate(r.randrange(2, 58) for _ in range(200))]
    rows += [(1000 + i, " ".join(base[:-1] + [f"y{i}"])) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, nj.joined(docs, like=nj.CONTRACT).collect()), key=str) == least_ids(rows, nj.CONTRACT)


@pytest.mark.parametrize("like", [nj.CONTRACT, nj.NEAR])
def test_links_always_share_a_signature(like):
    r = np.random.default_rng(7)
    some = [[np.where(r.random(1 << 17) < share, 255, 0).astype(np.uint8) for _ in range(2)] for share in (0.3, 0.9)]
    for size in (1, 2, 5, 9, 10, 23, 60, 200, 700):
        for _ in range(20):
            x = r.integers(0, 2**63, size * 2).astype(np.uint64)
            drop = r.integers(0, size // 5 + 1)
            a, b = np.unique(x[:size]), np.unique(np.concatenate((x[drop:size], x[size : size + r.integers(0, drop + 1)])))
            both = len(np.intersect1d(a, b))
            if like.whole * both >= like.part * (len(a) + len(b) - both) and len(b):
                offsets = np.array([0, len(a), len(a) + len(b)])
                of, sig, count, margin = nj.signatures(offsets, np.concatenate((a, b)), like)
                # Whatever is called common, in whatever degrees, linked sets still meet.
                for blooms in ([], *some):
                    keep = nj.emitted(of, sig, count, margin, blooms)
                    sent = [{(s, n) for s, n, k in zip(sig.tolist(), nj.agreeing(margin).tolist(), (keep & (of == i)).tolist()) if k} for i in (0, 1)]
                    both_ = [n for _, n in sent[0] & sent[1]]
                    assert any(both_.count(n) >= n for n in set(both_))


def test_pairs_of_a_signature():
    key, t = np.arange(100, 113), np.repeat([0, 1, 3, 6], [1, 2, 3, 7]).astype(np.int8)
    a, b, n = nj.pairs_of(key, t, np.array([0, 1, 3, 6]), np.array([1, 2, 3, 7]), 3)
    assert sorted(zip(a.tolist(), b.tolist(), n.tolist())) == sorted([(101, 102, 1), (103, 104, 3), (103, 105, 3), (104, 105, 3)] + [(106, 106 + i, 0) for i in range(1, 7)])
    got = nj.counted_pairs(np.array([1, 1, 2]), np.array([5, 5, 6]), np.array([3, 3, 0], dtype=np.int8)).to_pydict()
    assert got == {"a": [1, 2], "b": [5, 6], "t": [3, 0], "n": [2, 1]}


def test_units_of_long_texts_are_cut_by_grams(spark, monkeypatch):
    monkeypatch.setattr(nj, "GRAMS", 300)
    monkeypatch.setattr(nj, "LATE_BLOCK", 8)
    rows = _rows(9)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for like in (nj.CONTRACT, nj.NEAR):
        assert sorted(map(tuple, nj.joined(docs, like=like).collect()), key=str) == least_ids(rows, like)


def test_tree_links_are_the_pairs_that_link():
    r = np.random.default_rng(2)
    sets = [np.unique(r.choice(60, r.integers(1, 50), replace=False)).astype(np.uint64) for _ in range(40)] + [np.arange(40, dtype=np.uint64), np.arange(41, dtype=np.uint64), np.arange(1, 41, dtype=np.uint64)]
    for like in (nj.CONTRACT, nj.NEAR, nj.Likeness(3, 30, 100)):
        got, want = Forest(), Forest()
        nj.tree_links(sets, list(range(len(sets))), got, like)
        for i, j in itertools.combinations(range(len(sets)), 2):
            both = len(np.intersect1d(sets[i], sets[j]))
            if like.whole * both >= like.part * (len(sets[i]) + len(sets[j]) - both):
                want.link(i, j)
        assert [got.root(i) for i in range(len(sets))] == [want.root(i) for i in range(len(sets))]


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 70)] + [(100, i) for i in range(101, 140)] + [(-5, 140), (200, 200)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(71)}, **{i: 100 for i in range(100, 140)}, -5: -5, 140: -5}


def test_deduplicated_keeps_columns_and_one_of_each_group(spark):
    rows = _rows()
    docs = spark.createDataFrame([(k, t, str(k)) for k, t in rows], "doc_id long, text string, lang string")
    kept = nj.deduplicated(docs)
    assert set(kept.columns) == set(docs.columns)
    want = [k for k, _, c in least_ids(rows, nj.NEAR) if k is None or k == c]
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted(want, key=str)
    assert nj.deduplicated(docs.limit(0)).count() == 0
