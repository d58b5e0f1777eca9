import math
import random
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from papyra.llm import context_mix as cm


def _bits(words, counts):
    """Counts of both bits after each beginning, by hand."""
    node: dict = {}
    for w, c in zip(words, counts):
        s = w + cm.CLOSE
        for i, v in enumerate(s):
            for b in range(8):
                key = (s[:i], b, v >> (8 - b))
                n = node.setdefault(key, [0, 0])
                n[(v >> (7 - b)) & 1] += c
    return node


def test_whole_contexts_count_exactly_even_across_ranges():
    words = sorted({w.encode() for w in "a an and ant any b be bee been beer é".split()})
    f = np.arange(1, len(words) + 1)[:, None]
    node = _bits(words, f[:, 0].tolist())
    parts = [slice(0, 3), slice(3, 6), slice(6, 20)]
    total: dict = {}
    ends = [(words[p][0] + cm.CLOSE, words[p][-1] + cm.CLOSE) for p in parts]
    near = [(cm.common_prefix(ends[i][0], ends[i - 1][1]) if i else -1, cm.common_prefix(ends[i][1], ends[i + 1][0]) if i < 2 else -1) for i in range(3)]
    open_ = []
    for p, n in zip(parts, near):
        bits = cm.Bits(words[p])
        open_.append(cm.open_beginnings(bits, words[p], *n))
        for e in np.flatnonzero(np.isin(bits.whole, open_[-1])).tolist():
            key = int(bits.whole[e]), int(bits.byte[e])
            total[key] = total.get(key, 0) + bits.spread(f[p])[e]
    assert len(open_[0]) >= 1
    for p, o in zip(parts, open_):
        rows = [(k, b, n) for (k, b), n in total.items() if k in set(o.tolist())]
        bits = cm.Bits(words[p], f[p], (np.array([r[0] for r in rows], dtype=np.uint64), np.array([r[1] for r in rows]), np.array([r[2] for r in rows])))
        for j, w in enumerate(words[p]):
            s = w + cm.CLOSE
            mine = np.flatnonzero(bits.owner == j)
            for i, v in enumerate(s):
                e = bits.edge[mine[i]]
                for b in range(8):
                    n0, n1 = node[s[:i], b, v >> (8 - b)]
                    assert math.isclose(bits.exact[b][0][e], math.log((n1 + cm.EASE) / (n0 + cm.EASE)), rel_tol=1e-4, abs_tol=1e-4)


def test_a_models_probabilities_sum_to_one():
    words = [b"ab", b"ba", b"abc", cm.END]
    f = np.array([[3], [2], [1], [4]])
    order = sorted(range(4), key=lambda i: words[i])
    words, f = [words[i] for i in order], f[order]
    tables = [np.zeros(1 << size, dtype=np.int16) for _, size in cm.ORDERS]
    # All bytes that can come first: their costs are those of whole one-byte words before the closing space.
    model = cm.Model.blank(tables)
    total = 0.0
    every = [bytes([v]) for v in range(256)]
    bits = cm.Bits([*every], np.zeros((256, 1), dtype=int))
    log = np.zeros(len(bits))
    for b in range(8):
        x, y = model.inputs(bits, b), bits.bit(b)
        p = model.predict(x, model.gate(bits, b, 0))[1]
        log += np.log(np.where(y == 1, p, 1 - p))
    firsts = {int(bits.byte[bits.edge[i]]): log[bits.edge[i]] for i in range(len(bits.owner)) if i == 0 or bits.owner[i] != bits.owner[i - 1]}
    total = sum(math.exp(v) for v in firsts.values())
    assert len(firsts) == 256 and abs(total - 1) < 1e-6


def test_contract_columns_and_learning(spark):
    rows = [(i, ("the cat sat on the mat " if i % 2 else "le chat est sur la table ") * (1 + i % 4) + f"w{i % 7}", "en" if i % 2 else "fr") for i in range(150)]
    rows += [(None, "THE cat", None), (500, None, "en"), (501, "", "en"), (3, rows[3][1], "en"), (502, "zzz unseen\tWORDS \x00", "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 as word", "2 as c", "3 as score")
    small = {tuple(r)[:6]: r for r in cm.scores(docs, head=5).collect()}
    got = cm.scores(docs).collect()
    assert len(got) == len(rows)
    train = Counter()
    for k, t, _ in rows:
        if k is None or zlib.crc32(str(k).encode()) % 10:
            train.update([*(t or "").encode().lower().split(), b"\n"])
    n, v = sum(train.values()), len(train)
    want = {}
    for k, t, _ in rows:
        w = [*(t or "").encode().lower().split(), b"\n"]
        want[k, t] = (len(w), sum(train[x] > 0 for x in w), n, sum(math.log10((train[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w))
    by = {}
    for (k, _), x in want.items():
        by.setdefault(k, []).append(x)
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 10 == 0)
        assert any(x[:3] == (r.n_tokens, r.n_known, r.train_tokens) and math.isclose(x[3], r.base_score, rel_tol=1e-9) for x in by[r.doc_id])
        assert r.score < 0 and math.isfinite(r.score)
    # A small head gives the same: rare words come by the join.
    assert sorted((r.doc_id or -1, round(r.base_score, 6), round(r.score, 6)) for r in got) == sorted((r.doc_id or -1, round(r.base_score, 6), round(r.score, 6)) for r in cm.scores(docs, head=5).collect())
    odd = next(r for r in got if r.doc_id == 502)
    usual = [r for r in got if r.doc_id is not None and r.doc_id < 150]
    assert odd.score / odd.n_tokens < min(r.score / r.n_tokens for r in usual)
    assert small
    assert cm.scores(docs.limit(0)).count() == 0


def test_costs_are_the_predicted_probabilities():
    words = sorted({w.encode() for w in "a an and ant any b be bee been beer é".split()})
    rng = np.random.default_rng(0)
    f = rng.integers(0, 9, (len(words), 2))
    tables = [rng.integers(-3000, 3000, 1 << size).astype(np.int16) for _, size in cm.ORDERS]
    model = cm.Model.blank(tables)
    bits = cm.Bits(words, f)
    model.learn(bits, bits.spread(f), np.tile(np.eye(cm.INPUTS) * cm.PRIOR, (cm.GATES, 1, 1)))
    want = np.zeros((len(bits), 3))
    for b in range(8):
        x, y = model.inputs(bits, b), bits.bit(b)
        for g in range(3):
            x[:, -1] = bits.exact[b][g]
            p = model.predict(x, model.gate(bits, b, g))[1]
            want[:, g] += np.log10(np.where(y == 1, p, 1 - p))
    want = np.stack([bits.gathered(want[:, g], len(words)) for g in range(3)], axis=1)
    np.testing.assert_allclose(model.cost(bits, len(words)), want, rtol=1e-3, atol=1e-3)


def test_the_fold_that_teaches_weights_fills_the_scoring_contexts(spark):
    rows = [(i, "the cat sat on the mat" + (" zyxquv" * 3 if zlib.crc32(str(i).encode()) % 10 == 9 else ""), "en") for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    number, classes = cm.classes_of(docs, "doc_id", "lang")
    plain = cm.vocabulary(docs, number, classes, by="lang").withColumn("part", F.expr("cast(word >= 's' as int)"))
    dealt = lambda w: cm._dealt(cm.with_bounds(w), 2)
    learning, scoring, shared = cm.filled(dealt(plain))
    assert all((a != b).any() for a, b in zip(learning, scoring))
    # The tables that score are those of counts f + l in column f.
    both = plain.withColumn("f", F.zip_with("f", "l", lambda a, b: a + b)).withColumn("l", F.transform("l", lambda x: x * 0))
    _, alone, one = cm.filled(dealt(both))
    for a, b in zip(scoring, alone):
        np.testing.assert_array_equal(a, b)
    sums = lambda df: sorted((r.part, r.begin, r.byte, [x + y for x, y in zip(r.f, r.l)]) for r in df.collect())
    assert sums(shared) == sums(one) and {r.part for r in shared.collect()} == {0, 1}
    words = cm._dealt(plain, 2, shared)
    model = cm.learnt(words, learning)
    model.tables = scoring
    cost = {r.word: r.cost[0] for r in cm.costed(words, model).collect()}
    assert cost["zyxquv"] > -2.5  # seen in a ninth of the documents, thrice
    got = {r.doc_id: r.score for r in cm.scores(docs).collect()}
    with_word = [i for i, t, _ in rows if "zyxquv" in t]
    # Three such words more, which every context has seen: no more than 2.5 digits each.
    plain = min(s for i, s in got.items() if i not in with_word)
    assert with_word and all(got[i] > plain - 7.5 for i in with_word)


def test_first_bytes_sum_to_one_and_follow_the_token_before():
    r = np.random.default_rng(1)
    by_class, pairs = r.integers(0, 50, (3, 256)).astype(float), np.zeros((8, 256))
    pairs[1, 97], pairs[2, 98] = 300, 300
    cost = cm.Openings().learn(by_class[0], pairs, pairs).costs(by_class, pairs).reshape(8, 256, 3)
    np.testing.assert_allclose((10.0**cost).sum(axis=1), 1, rtol=1e-3)
    assert cost[1, 97, 0] > -0.1 and cost[2, 97, 0] < -1 and abs(cost[0, 97, 0] - np.log10((by_class[0, 97] + 0.4) / (by_class[0].sum() + 0.8))) < 0.5


def test_the_order_of_words_counts_and_copies_score_apart(spark):
    r = np.random.default_rng(2)
    words = [f"w{i}" for i in range(400)]
    text = lambda n: " ".join(r.choice(words, n))
    rows = [(i, text(150)) for i in range(120)]
    rows += [(1000 + i, f"{a} {b} {a} {b} {a} {b}") for i in range(100) for a, b in [("black", "cat")]]
    rows += [(2000, "black cat"), (2001, "cat black")] + [(3000 + 2 * i + j, t) for i in range(20) for t in [text(150)] for j in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: x for x in cm.scores(docs, by=None).collect()}
    assert got[2000].score > got[2001].score + 0.5
    training = lambda k: zlib.crc32(str(k).encode()) % 10 != 0
    once = [got[k].score for k in range(120) if training(k)]
    twice = [got[k].score for k in range(3000, 3040) if training(k) and training(k ^ 1)]
    assert np.mean(twice) > np.mean(once) + 15


def test_a_very_long_word_takes_memory_in_proportion(spark):
    docs = spark.createDataFrame([(i, "x" * 300_000 if i == 7 else f"a b c{i}") for i in range(30)], "doc_id long, text string")
    got = {x.doc_id: x for x in cm.scores(docs, by=None).collect()}
    assert len(got) == 30 and all(math.isfinite(x.score) for x in got.values()) and got[7].n_tokens == 2


def test_ranges_are_cut_by_the_bytes_of_their_words(spark):
    words = [f"{'字' * 90}{i:05d}" for i in range(3000)] + [f"w{i}" for i in range(3000)] + ["x" * 40_000]
    df = spark.createDataFrame([(w, [1], [0]) for w in words], "word string, f array<long>, l array<long>").repartition(5)
    ranged, parts = cm.in_ranges(df, 2, most=30_000)
    got = ranged.collect()
    assert len(got) == len(words) and {r.part for r in got} == set(range(parts))
    of: dict = {}
    for r in got:
        of.setdefault(r.part, []).append(r.word)
    assert all(sum(len(w.encode()) + 1 for w in ws) <= 30_000 or max(map(len, ws)) >= 40_000 or len(ws) < 120 for ws in of.values())
    assert max(sum(len(w.encode()) + 1 for w in ws) for ws in of.values()) <= 30_000 + 40_001
    bounds = sorted((p, min(ws), max(ws)) for p, ws in of.items())
    assert all(a[2] < b[1] for a, b in zip(bounds, bounds[1:]))
    assert cm.in_ranges(df.limit(0), 1)[1] == 0


def test_every_place_behind_enough_tokens_asks_what_follows():
    words, starts, count = cm.tokens_of(["a b c d e f g h i j k l", "x y", "a b c d e f"])
    check = cm.checks_of(words)
    at, ctx = cm.preceded(check, starts, count)
    assert at.tolist() == [*range(4, 13), *range(20, 23)]
    assert ctx[9:].tolist() == ctx[:3].tolist() and (ctx >= cm.FIRSTS).all()  # the same four tokens before, in whichever text
    assert len(set(ctx.tolist())) == 9


def test_followers_are_the_counts_by_brute_force_in_any_number_of_parts(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 30))) for _ in range(120)]
    texts += [" ".join(f"w{i}x{j}" for j in range(300)) for i in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want: dict[int, Counter] = {}
    for i, t in enumerate(texts):
        words, starts, count = cm.tokens_of([t])
        check = cm.checks_of(words)
        at, ctx = cm.preceded(check, starts, count)
        kind = {0: "z", cm.FOLDS - 1: "l"}.get(cm.fold_of(i), "f")
        for c, x in zip(ctx.tolist(), check[at].tolist()):
            want.setdefault(c, Counter())[x, kind] += 1
    rows = {}
    for c, seen in want.items():
        nx = {x for x, _ in seen}
        f, l, z = ({x: seen[x, k] for x in nx} for k in "flz")
        total = sum(f.values()) + sum(l.values())
        if total >= 2 or (total >= 1 and sum(z.values())):
            n, top = max((f[x] + l[x], x) for x in nx)
            learnt, best = max((f[x], x) for x in nx)
            rows[c] = (top, n, total, learnt, sum(f.values()), l[best], sum(l.values()))
    for parts in (1, 5):
        got = cm.followers(docs, "doc_id", "text", parts)
        assert {r.ctx: tuple(r)[1:] for r in got.filter(F.col("ctx") >= cm.FIRSTS).collect()} == rows
        cells = got.filter(F.col("ctx") < cm.FIRSTS).agg(F.sum("of"), F.sum("trials")).first()
        tokens = [(cm.fold_of(i), len(cm.words_of(t)) + 1) for i, t in enumerate(texts)]
        assert tuple(cells) == (sum(n for f, n in tokens if f not in (0, cm.FOLDS - 1)), sum(n for f, n in tokens if f == cm.FOLDS - 1))
    assert cm.followers(docs.limit(0), "doc_id", "text").filter(F.col("ctx") >= cm.FIRSTS).count() == 0


def test_asks_are_packed_and_told_as_by_hand():
    import pyarrow as pa

    rng = np.random.default_rng(3)
    head = [b"a", b"b", b"c"]
    value, opens = np.concatenate((rng.random((3, 3)), np.zeros((1, 3)))).astype(np.float32), rng.random((cm.FIRSTS, 2)).astype(np.float32)
    check_of_head = np.append(cm.checks_of(head), 0)
    chance = rng.uniform(0.1, 0.9, cm.FOLLOW_GATES).tolist()
    size = 4000
    ctx = rng.integers(1 << 47, (1 << 47) + 50, size) - rng.integers(0, 2, size)
    number, doc = rng.integers(-1, 3, size), np.sort(rng.integers(0, 30, size))
    cell = rng.integers(0, cm.FIRSTS, size)
    rare = [[b"odd", "字".encode()][i % 2] for i in range(int((number < 0).sum()))]
    docs = np.arange(100, 130) - 110, rng.integers(-9, 9, 30) << 40, np.arange(30) % 3
    found = pa.table({"ctx": np.arange(1 << 47, (1 << 47) + 40)[::-1].copy(), "nx": cm.checks_of([[*head, b"odd"][i % 4] for i in range(40)]), "n": np.arange(40) % 5 + 1, "total": np.arange(40) % 5 + 1 + np.arange(40) % 3})
    rows = cm.asks_of(ctx % 7, ctx, number, cell, doc, rare, docs)
    assert len(rows) == 7 and sum(len(r["high"]) + len(r["low"]) + len(r["code"]) + len(r["token"]) for r in rows) == 12 * size
    answers = cm.Answers(found, chance, value, opens, check_of_head)
    got: dict = {}
    for r in rows:
        for t in answers.told(*cm.asked(r)).to_pylist():
            x = got.setdefault((t["k"], t["h"], t["word"]), np.zeros(4))
            x += [t["s0"], t["s1"], t["extra"], t["word"] is not None]
    follow, want, left = {r["ctx"]: r for r in found.to_pylist()}, {}, iter(rare)
    for c, i, o, d in zip(ctx.tolist(), number.tolist(), cell.tolist(), doc.tolist()):
        word = head[i] if i >= 0 else next(left)
        own = int(docs[2][d] > 0)
        key = None if docs[2][d] == 2 else int(docs[0][d]), int(docs[1][d])
        if (f := follow.get(c)) is None or f["total"] - own < 1:
            continue
        same = zlib.crc32(word) == f["nx"]
        others, of = f["n"] - own * same, f["total"] - own
        came = same and others >= 1
        gate = sum(max(others, 1) >= b for b in cm.OFTEN) * (len(cm.SURE) + 1) + sum(max(others, 1) * 100 / of >= b for b in cm.SURE)
        x = want.setdefault((*key, None), np.zeros(4))
        x[2] += math.log10(chance[gate] if came else 1 - chance[gate])
        if came:
            x[:2] -= value[i, 1:] + opens[o]
            if i < 0:
                want.setdefault((*key, word.decode()), np.zeros(4))[3] += 1
    assert got.keys() == want.keys() and any(w for _, _, w in want)
    for k in want:
        np.testing.assert_allclose(got[k], want[k], rtol=1e-5)


def test_contexts_known_everywhere_give_what_asking_gives(spark, monkeypatch):
    rows = [(i, "one two three four five six " * 3 + ("seven eight" if i % 3 else f"nine w{i}")) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    score = lambda: {r.doc_id: r.score for r in cm.scores(docs, by=None, head=6).collect()}
    asked = score()
    monkeypatch.setattr(cm, "HOT", 1)
    monkeypatch.setattr(cm, "MET", 500)  # many parts
    parts = score()
    assert asked.keys() == parts.keys() and all(math.isclose(asked[k], parts[k], rel_tol=1e-9) for k in asked)
    monkeypatch.setattr(cm, "HOT_LEAST", 0)
    monkeypatch.setattr(cm, "HOT", 100_000)
    known = score()
    assert all(math.isclose(asked[k], known[k], rel_tol=1e-9) for k in asked)
