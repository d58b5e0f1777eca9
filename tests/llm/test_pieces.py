import itertools
import os
import random

import numpy as np
import pytest

from papyra.llm import piece_encode as pe
from papyra.llm import token_counts as tc
from papyra.llm.pieces import MODEL, Pieces, load

needs_model = pytest.mark.skipif(not os.path.exists(MODEL), reason="vocabulary file is not here")
ODD = ["", " ", "  ", "a  b", "   x   y  \n\n\tz ", "aaaaaaaaaa", "▁a▁▁b", "日本語テスト🙂🙂", "naïve café \x00 x", "ééééé", " " * 40 + "x", "1234567890", "the" * 50, "x" * 3000]


def _texts():
    r = random.Random(4)
    return ODD + ["".join(r.choice("abeinrst .é\n") for _ in range(60)) for _ in range(300)] + [" " * k + "x" for k in range(40)]


@needs_model
def test_ids_and_counts_are_the_librarys():
    import sentencepiece

    lib, pieces = sentencepiece.SentencePieceProcessor(model_file=MODEL), load()
    texts = _texts()
    offsets, ids = pe.Encoder(pieces)(texts)
    counts, _ = tc.Counter(pieces)(texts)
    assert pe.Decoder(pieces)(offsets, ids) == [t.replace("▁", " ") for t in texts]
    for k, (t, want) in enumerate(zip(texts, lib.encode(texts))):
        got = ids[offsets[k] : offsets[k + 1]]
        assert got.tolist() == want and counts[k] == len(want)


@needs_model
def test_characters_outside_the_vocabulary_in_any_place():
    import sentencepiece

    lib, pieces = sentencepiece.SentencePieceProcessor(model_file=MODEL), load()
    r = random.Random(5)
    assert pieces.distinct_joins(np.array([3, 3, -1, -2]), np.array([-2, -2, -2, 5])).all()
    texts = ["the 鱻", "é龘", "漢字 龘", "hello 龘龘 world"]
    for block in range(0x20, 0x20000, 0x80):  # some of each block of code points, behind and before words
        some = [chr(c) for c in range(block, block + 0x80, 5) if not 0xD800 <= c < 0xE000]
        texts += ["".join(r.choice(["the ", " of", "ab", "", "é", "漢", *some]) for _ in range(12)) + c for c in some[:6]]
    offsets, ids = pe.Encoder(pieces)(texts)
    counts, _ = tc.Counter(pieces)(texts)
    for k, (t, want) in enumerate(zip(texts, lib.encode(texts))):
        assert ids[offsets[k] : offsets[k + 1]].tolist() == want and counts[k] == len(want), t


@needs_model
def test_very_long_words_are_the_librarys():
    import sentencepiece

    lib, pieces = sentencepiece.SentencePieceProcessor(model_file=MODEL), load()
    r = random.Random(6)
    texts = ["".join(r.choice(abc) for _ in range(n)) for abc in ("abcdefghij", "aeinrst", "ABCabc0123+/", "日本語漢字龘鱻é", "ab") for n in (505, 511, 513, 2000, 60_000)] + ["a" * 100_000, "hello" * 5000 + " and " + "y" * 700]
    offsets, ids = pe.Encoder(pieces)(texts)
    counts, _ = tc.Counter(pieces)(texts)
    assert pe.Decoder(pieces)(offsets, ids) == texts
    for k, (t, want) in enumerate(zip(texts, lib.encode(texts))):
        assert ids[offsets[k] : offsets[k + 1]].tolist() == want and counts[k] == len(want), t[:20]


def test_long_paths_of_a_unigram_model_are_as_good():
    pieces = _unigram()
    r = random.Random(7)
    for n in (520, 700):
        word = "".join(r.choice("abé") for _ in range(n))
        whole = pe.relaxed([word], pieces)[1]
        by_steps = [0.0] + [-np.inf] * n
        scores = dict(zip(pieces.text, pieces.scores))
        for j in range(1, n + 1):
            by_steps[j] = max(by_steps[i] + scores.get(word[i:j], -np.inf) for i in range(max(0, j - 3), j))
        of_id = dict(zip(pieces.ids.tolist(), pieces.scores.tolist()))
        assert abs(sum(of_id[i] for i in whole.tolist()) - by_steps[n]) < 1e-6
        assert tc.counted([word], pieces, tc.Lookup(pieces))[0] == len(whole)


def _unigram():
    text = [" ", "a", "b", "ab", "aba", " a", "ba", "bb", " ab", "é"]
    return Pieces("unigram", text, np.arange(3, 3 + len(text)), np.array([-3.0, -2, -2.5, -3.1, -3.3, -3.2, -3.05, -4.9, -4, -2]), np.arange(100, 356))


def test_unigram_paths_are_the_best_of_all():
    pieces = _unigram()
    score = dict(zip(pieces.text, pieces.scores))

    def best(word):
        found = []
        for cuts in itertools.product((0, 1), repeat=len(word) - 1):
            parts, at = [], 0
            for i, c in enumerate(cuts, 1):
                if c:
                    parts.append(word[at:i])
                    at = i
            parts.append(word[at:])
            if all(p in score or len(p) == 1 for p in parts):
                found.append((sum(score.get(p, pieces.worst) for p in parts), parts))
        return max(found)

    words = ["".join(w) for n in range(1, 6) for w in itertools.product("abé", repeat=n)] + [" abab", " aé", "aca", "ü"]
    offsets, ids = pe.relaxed(words, pieces)
    counts = tc.counted(words, pieces, tc.Lookup(pieces))
    for k, w in enumerate(words):
        total, parts = best(w)
        got = ids[offsets[k] : offsets[k + 1]]
        of_id = dict(zip(pieces.ids.tolist(), pieces.text))
        mine = sum(score[of_id[i]] if i in of_id else 0 for i in got.tolist())
        lone = [c for c in w if c not in score]
        if not lone:
            assert abs(mine - total) < 1e-9, w
            assert counts[k] == len(got)
        else:
            assert [i for i in got.tolist() if i >= 100] == [100 + b for c in lone for b in c.encode()] and counts[k] == len(got)


def test_suffix_array_orders_all_suffixes():
    r = np.random.default_rng(3)
    x = r.integers(97, 99, 300).astype(np.uint8)
    sa = pe.suffix_array(x, 512)
    tail = bytes([255]) * 600
    assert sa.tolist() == sorted(range(300), key=lambda i: x[i:].tobytes() + tail)


@needs_model
def test_frames(spark):
    rows = [(1, "Hello world"), (2, None), (3, ""), (1, "Hello world"), (None, "x  y\n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as ids", "2 as n_tokens")
    got = pe.encoded(docs).collect()
    assert len(got) == 5
    assert [(r.n_tokens, r.ids, r.intact) for r in got if r.doc_id == 2] == [(None, None, None)]
    assert [(r.n_tokens, r.ids, r.intact) for r in got if r.doc_id == 3] == [(0, [], True)]
    assert all(r.intact and r.n_tokens == len(r.ids) for r in got if r.doc_id != 2)
    back = sorted(map(tuple, pe.decoded(pe.encoded(docs)).collect()), key=str)
    assert back == sorted(rows, key=str)
    counts = sorted(((r.doc_id, r.n_tokens) for r in tc.token_counts(docs).collect()), key=str)
    assert counts == sorted(((r.doc_id, r.n_tokens or 0) for r in got), key=str)
    assert pe.encoded(docs.limit(0)).count() == tc.token_counts(docs.limit(0)).count() == 0
