import random

import pytest

from papyra.operators import terms as tm


def _brute(texts, terms):
    best: dict = {}
    for key, text, scope in texts:
        for owner, term, of in terms:
            at = (text or "").find(term) if term and of == scope else -1
            if at >= 0:
                found = (at, -len(term), term)
                best[key, owner] = min(best.get((key, owner), found), found)
    return sorted((k, o, t, at) for (k, o), (at, _, t) in best.items())


@pytest.mark.parametrize("shard", [1 << 20, 700])
@pytest.mark.parametrize("scope", [None, "book"])
def test_earliest_hits_by_brute_force(spark, shard, scope):
    rng = random.Random(4)
    letters = ["a", "b", "ab", "字", "😀", " "]
    word = lambda n: "".join(rng.choice(letters) for _ in range(n))
    texts = [(i, word(rng.randrange(40)), rng.choice("xy")) for i in range(120)] + [(200, None, "x"), (201, "", "x"), (202, "ab" * 30_000 + "字字", "y"), (7, "ab b", "x"), (203, "a", "z")]
    terms = [(rng.randrange(15), word(rng.randrange(1, 5)), rng.choice("xy")) for _ in range(60)] + [(3, "", "x"), (3, None, "x"), (4, "a", "x"), (4, "a", "x"), (99, "字字", "y")]
    d = spark.createDataFrame(texts, "id long, text string, book string").repartition(5).selectExpr("*", "1 as term", "2 as shard")
    t = spark.createDataFrame(terms, "who long, term string, book string").selectExpr("*", "9 as at")
    got = tm.earliest_hits(d, t, key=["id"], text="text", scope=scope, owner="who", shard=shard, cell=4000)
    same = (lambda s: s) if scope else (lambda s: None)
    want = _brute([(i, x, same(s)) for i, x, s in texts], [(o, x, same(s)) for o, x, s in terms])
    assert sorted((r.id, r.owner, r.term, r.at) for r in got.collect()) == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_no_terms_and_no_texts(spark):
    d = spark.createDataFrame([(1, "a")], "id long, text string")
    t = spark.createDataFrame([], "owner string, term string")
    assert tm.earliest_hits(d, t, key=["id"], text="text").count() == 0
    assert tm.earliest_hits(d.limit(0), spark.createDataFrame([("o", "a")], t.schema), key=["id"], text="text").count() == 0


def test_many_terms_meet_no_text_twice(spark):
    """A text goes to Python once however many terms there are, few pieces pass that are no terms, and nothing is broadcast or grouped."""
    d = spark.createDataFrame([(i, f"Name#{i:06d} and others") for i in range(3000)], "id long, text string").repartition(8)
    t = spark.createDataFrame([(i, f"Name#{i:06d}") for i in range(0, 6000, 2)] + [(i, f"the {i}") for i in range(3000)], "owner long, term string")
    got = tm.earliest_hits(d, t, key=["id"], text="text", shard=1000, cell=2000)
    assert sorted((r.id, r.owner, r.term, r.at) for r in got.collect()) == [(i, i, f"Name#{i:06d}", 0) for i in range(0, 3000, 2)]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "CoGroup" not in plan and "Generate" not in plan and "MapInArrow" in plan
    executed = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in executed and "Broadcast" not in executed


def test_bloom_holds_all_terms_and_few_others():
    import numpy as np

    from papyra.operators.terms import Hashed, _holds, _probe

    words = [f"Customer#{i:09d}" for i in range(5000)]
    h = Hashed("".join(words)).pieces(np.arange(5000) * 18, np.full(5000, 18), np.zeros(5000, dtype=np.uint64))
    assert len(set(h.tolist())) == 5000
    assert (Hashed("x " + words[7]).every(18, np.zeros(20, dtype=np.uint64))[2] == h[7]).all()
    bits, on = 17, np.zeros(1 << 17, dtype=bool)
    for i in range(4):
        on[_probe(h[:4000], i, bits)] = True
    found = _holds(np.packbits(on), h)
    assert set(range(4000)) <= set(found.tolist()) and len(found) < 4040
