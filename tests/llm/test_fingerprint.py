import hashlib

import numpy as np
from pyspark.sql import functions as F

from papyra.llm import fingerprint as fp


def test_entropy_sums_match_a_direct_count():
    rng = np.random.default_rng(1)
    text = bytes(rng.integers(97, 103, 400, dtype=np.uint8))
    pad = bytes(fp.WINDOW + fp.STRETCH)
    x = np.frombuffer(text + pad, dtype=np.uint8)
    ranks = []
    for i in range(len(text) - fp.WINDOW + 1):
        counts = np.unique(x[i : i + fp.WINDOW], return_counts=True)[1]
        total = int(sum(int(np.rint((fp._LOG[c] - fp._LOG[c - 1]) * fp.SCALE)) for n in counts for c in range(1, n + 1)))
        ranks.append(int(fp._RANK[total * 64 // fp.SCALE]))
    votes = np.zeros(len(ranks), dtype=int)
    for i in range(len(ranks)):
        stretch = [(r, i + j) for j, r in enumerate(ranks[i : i + fp.STRETCH]) if r >= 0]
        if stretch and ranks[i] >= 0:
            votes[min(stretch)[1]] += 1
    begin = [int(fp._beginnings(x)[1][i]) for i in range(len(text))]
    unit = lambda h: (h >> 11) / 2**53
    n = len(text)
    few = [unit(begin[i]) < min(1, fp.FEW / (n - fp.WINDOW + 1)) for i in range(len(ranks))]
    large = [i for i in range(len(ranks)) if votes[i] >= fp.VOTES or (few[i] and ranks[i] >= 0)]
    again = [int(fp._mixed(np.array([b], dtype=np.uint64) ^ np.uint64(0xD1B54A32D192ED03))[0]) for b in begin]
    small = [i for i in range(n - fp.SMALL + 1) if unit(again[i]) < min(1, fp.FEW / (n - fp.SMALL + 1)) ** 2 and len(set(text[i : i + fp.SMALL])) > 1]
    position, hashes = fp._features(x, np.array([0]), np.array([len(text)]))
    assert position.tolist() == sorted(large + small) and len(large) > 30 and small
    assert len(set(hashes.tolist())) > 1


def _overlap(a, b):
    """Likeness of two fingerprints, from their text, bit by bit."""
    if not a or not b:
        return float(a == b)
    read = lambda f: [(int(part.split(".")[0]), int(part.split(".")[1], 16)) for part in f.split(":")[1:]]
    p, q = sorted((read(a), read(b)), key=lambda c: (len(c), sum(n for n, _ in c)))
    total = 0.0
    for n, bits in p:
        scores = []
        for _, other in q:
            m, k, both = bits.bit_count(), other.bit_count(), (bits & other).bit_count()
            chance = m * k / fp.BITS
            scores.append(min(1.0, max(0.0, (both - chance) / (min(m, k) - chance))))
        total += n * max(scores)
    return 1.0 if a == b else total / sum(n for n, _ in p)


def test_likeness_is_the_overlap_of_bits(spark):
    rng = np.random.default_rng(3)
    words = ["stone", "river", "über", "字", "the", "of", "Quartz", "and"]
    texts = [" ".join(rng.choice(words, int(n))) for n in rng.integers(1, 400, 30)] + ["", None, "ab", "x" * 300, "word " * 40_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(fp.fingerprints(docs).collect(), key=lambda r: r.doc_id)
    for r, after in zip(got, [*got[1:], got[0]]):
        assert abs(r.near_edited - _overlap(r.fingerprint, r.edited_fingerprint)) < 1e-6
        assert abs(r.near_next - _overlap(r.fingerprint, after.fingerprint)) < 1e-6


def test_three_quarters_of_a_short_text_are_seen():
    rng = np.random.default_rng(5)
    letters = np.frombuffer(b"etaoinshrdlu wmfgyp", dtype=np.uint8)
    worst: dict = {}
    for n in (12, 16, 24, 32, 48, 63, 64, 65, 80, 100, 150, 300):
        for _ in range(40):
            text, other = (bytes(rng.choice(letters, n)) for _ in range(2))
            a, b, c = fp.chains([text, text[: n - n // 4] + other[: n // 4], other])
            worst[n] = min(worst.get(n, 1.0), fp.likeness(a, b))
            assert fp.likeness(a, c) < 0.25
    assert min(worst.values()) > 0.4, worst


def test_chains_dont_depend_on_neighbours_and_equal_texts_are_equal():
    texts = [b"the quick brown fox jumps over the lazy dog " * 9, b"", b"short", b"x" * 500, "naïve café ".encode() * 40]
    together = fp.chains(texts)
    for t, c in zip(texts, together):
        alone = fp.chains([t], block=1)[0]
        assert fp.encoded(c) == fp.encoded(alone) and fp.likeness(c, alone) == 1.0
    assert fp.encoded(together[1]) == "" and fp.likeness(together[1], together[2]) == 0.0


def test_query_rows(spark):
    rows = [(5, "a" * 3 + "bcdefghij" * 20), (1, "hello world, this is a text. " * 12), (9, None), (3, ""), (7, "tiny"), (1, "hello world, this is a text. " * 12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("part", F.lit(1)).withColumn("t", F.lit("clash"))
    got = sorted(map(tuple, fp.fingerprints(docs).collect()), key=str)
    order = sorted(((k, t or "") for k, t in rows), key=lambda r: r)
    want = []
    for i, (k, t) in enumerate(order):
        z = order[(i + 1) % len(order)][1]
        edited = t[: len(t) - len(t) // 4] + z[: len(t) // 4]
        want.append((k, len(t), hashlib.sha256(edited.encode()).hexdigest()))
    assert [g[:3] for g in got] == sorted(want, key=str)
    twins = [g for g in got if g[0] == 1]
    assert twins[0][3] == twins[1][3] and 1.0 in {g[6] for g in twins}
    assert all(0 <= g[5] <= 1 and 0 <= g[6] <= 1 for g in got)


def test_one_row_and_none(spark):
    one = spark.createDataFrame([(None, "abcdefgh")], "doc_id long, text string")
    row = fp.fingerprints(one).collect()[0]
    assert row.doc_id is None and row.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest() and row.near_next == 1.0
    assert fp.fingerprints(one.limit(0)).count() == 0
