import hashlib
import random

import numpy as np
import pytest

from papyra.llm import block_names as bn
from papyra.llm.runs import Edges

SPACE = str.maketrans("", "", " \t\n\x0b\x0c\r")


@pytest.fixture(autouse=True)
def many_partitions(spark):
    """Small tables stay in as many partitions as they were dealt to, so that runs cross their edges."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    yield
    spark.conf.unset(name)


def _brute(rows):
    groups: dict = {}
    for i, (k, t) in enumerate(rows):
        groups.setdefault((t or "").translate(SPACE), []).append((-len(t or ""), k is None, k or 0, i))
    out = []
    for rest, members in groups.items():
        keep = rows[min(members)[3]][0]
        ids = sorted(str(rows[m[3]][0]) for m in members)
        out.append((str(keep), len(members), ids, hashlib.sha256(rest.encode()).hexdigest()))
    return sorted(out)


def _got(spark, rows, block, schema="doc_id long, text string"):
    df = spark.createDataFrame(rows, schema).repartition(5).selectExpr("*", "monotonically_increasing_id() as r")
    found = bn.classes(df, block=block).collect()
    assert len(found) == len(rows)
    groups: dict = {}
    for r in found:
        groups.setdefault(r.sha256, []).append(r)
    for members in groups.values():
        assert sum(r.kept for r in members) == 1 and len({(r.keep, r.group_size, r.keep_r) for r in members}) == 1
        assert next(r.k for r in members if r.kept) == members[0].keep
    return sorted((str(m[0].keep), m[0].group_size, sorted(str(r.k) for r in m), sha) for sha, m in groups.items())


@pytest.mark.parametrize("block", [2, 1024])
def test_equal_texts_by_brute_force(spark, block):
    rng = random.Random(block)
    words = ["ab", "ba", "aa", "é", "字", " ", "\t", "\x0b", " ", " ", "\r\n"]
    rows = [(i, "".join(rng.choice(words) for _ in range(rng.randrange(9)))) for i in range(300)]
    rows += [(None, "ab"), (None, None), (None, ""), (900, None), (901, " \n"), (902, ""), (5, "ab"), (5, "ab"), (5, "a b"), (7, rows[7][1])]
    rows += [(1000 + i, "hot text") for i in range(200)]  # a group that fills more than one partition
    assert _got(spark, rows, block) == _brute(rows)


def test_long_texts_differ_in_their_last_byte(spark):
    long = "0123456789" * 50_000
    rows = [(1, long + "a"), (2, long + "b"), (3, long + " a"), (4, long), (5, long[:-1]), (6, "x" + long + "a")]
    assert _got(spark, rows, 1 << 15) == _brute(rows)


def test_keys_of_text_and_an_empty_table(spark):
    rows = [("b", "x y"), ("a", "xy"), ("c", "x y")]
    assert _got(spark, rows, 8, "doc_id string, text string") == [("b", 3, ["a", "b", "c"], hashlib.sha256(b"xy").hexdigest())]
    assert _got(spark, [], 8) == []


def test_rows_that_stay_have_the_columns_of_docs(spark):
    docs = spark.createDataFrame([(1, "a b", 9), (2, "ab", 8), (3, "c", 7), (3, "c", 7)], "doc_id long, text string, r long").selectExpr("*", "1 as name", "2 as `a.b`", "3 as k")
    out = bn.deduplicated(docs)
    assert out.columns == docs.columns
    assert sorted((r.doc_id, r.text, r.r) for r in out.collect()) == [(1, "a b", 9), (3, "c", 7)]
    assert bn.deduplicated(docs.limit(0)).count() == 0


def test_equal_values_have_one_name_over_partitions(spark):
    rows = [(bytes([v % 7]), i, 0, 1) for i, v in enumerate(range(300))] + [(b"hot", 1000 + i, 0, 1) for i in range(600)]
    found, behind = bn.named(spark.createDataFrame(rows, "b binary, r long, i long, n long"), ["b"])
    names: dict = {}
    for r in found.collect():
        names.setdefault(rows[r.r][0] if r.r < 300 else b"hot", set()).add(r.name)
    assert len(names) == 8 and all(len(v) == 1 for v in names.values()) and len(set.union(*names.values())) == 8
    assert behind.filter("run is null").count() > 1


def test_values_that_share_a_fingerprint():
    edges = Edges()
    h = np.array([5, 5, 5, 8, 9, 9])
    edges.add(h[:4], np.array([0, 2, 3]), lambda j: (j,))
    edges.add(h[4:], np.array([0, 1]), lambda j: (j + 4,))
    assert edges.told() == [(0,), (2,), (4,), (5,)]
    one = Edges()
    one.add(h[:3], np.array([0, 2]), lambda j: (j,))
    assert one.told() == [(0,), (2,)]
