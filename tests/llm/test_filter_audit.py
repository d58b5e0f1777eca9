import random
from itertools import permutations

import pytest

from papyra.llm import filter_audit as fa

SPACE = " \t\n\x0b\x0c\r"


@pytest.fixture(autouse=True)
def many_partitions(spark):
    """Small tables stay in as many partitions as they were dealt to, so that runs cross their edges."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    yield
    spark.conf.unset(name)


def _words(t):
    out, word = [], ""
    for c in t + " ":
        if c in SPACE:
            out, word = out + [word] if word else out, ""
        else:
            word += c
    return out


def _fails(rows):
    least: dict = {}
    for k, t, _ in rows:
        if k is not None:
            least[t or ""] = min(k, least.get(t or "", k))
    for k, t, part in rows:
        t = t or ""
        w = _words(t)
        a = len(w) < 50
        b = 100 * len(set(w)) < 65 * len(w)
        c = 100 * sum("A" <= x <= "Z" for x in t) > 5 * len(t)
        d = any(x in "#$%&*|" for x in t)
        e = k is not None and k > least[t]
        yield part or "", k, "".join(f for f, x in zip("ABCDE", (a, b, c, d, e)) if x)


def _brute(rows, labels):
    good = {k for k, q, _ in labels if q == 1 and k is not None}
    toxic = {k for k, _, x in labels if x == 1 and k is not None}
    found = list(_fails(rows))
    out = {}
    for part in {p for p, _, _ in found}:
        mine = [(k, f) for p, k, f in found if p == part]
        for order in map("".join, permutations("ABCDE")):
            for step, x in enumerate(order, 1):
                before = set(order[: step - 1])
                removed = [k for k, f in mine if x in f and not before & set(f)]
                kept = sum(not (before | {x}) & set(f) for _, f in mine)
                redundant = sum(x in f and bool(before & set(f)) for _, f in mine)
                unique = sum(f == x for _, f in mine)
                out[part, order, step] = [kept, len(removed), redundant, unique, sum(k in good for k in removed), sum(k in toxic for k in removed)]
    share: dict = {}
    for (part, order, step), v in out.items():
        share[part, order[step - 1]] = share.get((part, order[step - 1]), 0) + v[1]
    return {(p, o, s): (*v, share[p, o[s - 1]]) for (p, o, s), v in out.items()}


def _rows():
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(80)] + ["Abc", "ABC", "#", "a|b", "é", "字", "x y"]
    rows = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([0, 3, 49, 50, 51, 120]))), rng.choice(["s0", "s1", None, ""])) for i in range(120)]
    rows += [(200 + i, rows[i][1], "copies") for i in range(40)] + [(1000 + i, "the hot text " * 30, "hot") for i in range(150)]
    rows += [(None, "the hot text " * 30, "hot"), (None, None, None), (300, None, "s0"), (301, "", "s0"), (200, rows[0][1], "copies"), (200, rows[0][1], "copies")]
    rows += [(2000, "A" * 5 + "b" * 95, "edge"), (2001, "A" * 6 + "b" * 94, "edge"), (2002, "é" * 94 + "A" * 5, "edge"), (2003, "word " * 200_000, "edge")]
    return rows


def test_all_orders_by_brute_force(spark):
    rows = _rows()
    labels = [(i, i % 2, int(i % 3 == 0)) for i in range(150)] + [(5, None, 1), (None, 1, 1), (7, 0, 0), (7, 1, 1), (99_999, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6).selectExpr("*", "1 as mask", "2 as part", "3 as k")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    masked, _ = fa.masks(docs)
    got = fa.audit(fa.counters(masked, lab)).collect()
    want = _brute(rows, labels)
    assert len(got) == len(want) == 120 * 5 * 6
    assert {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in got} == want


def test_counters_add_up(spark):
    docs = spark.createDataFrame([(i, t, s) for i, t, s in _rows()[:120]], "doc_id long, text string, source string")
    lab = spark.createDataFrame([(3, 1, 0)], "doc_id long, quality int, toxic int")
    one = fa.counters(fa.masks(docs)[0], lab)
    texts_apart = [fa.counters(fa.masks(docs.filter(f"crc32(text) % 2 = {i}"))[0], lab) for i in (0, 1)]
    assert sorted(map(tuple, fa.merged(*texts_apart).collect())) == sorted(map(tuple, one.collect()))


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    lab = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert fa.audit(fa.counters(fa.masks(docs)[0], lab)).count() == 0
