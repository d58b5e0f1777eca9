import random

from papyra.operators.intervals import valid_rows


def test_range_join_by_brute_force(spark):
    g = random.Random(6)
    points = [(i, g.choice("ab"), g.randrange(-20, 60)) for i in range(200)] + [(900, "a", None), (901, None, 3), (902, "z", 3), (5, "a", 4), (5, "a", 4)]
    spans = [(i, g.choice("abc"), s, g.choice([0, None, s, s + g.randrange(-3, 40)])) for i, s in ((i, g.randrange(-20, 60)) for i in range(150))]
    spans += [(500, "a", -1000, 1_000_000), (501, "a", None, 5), (502, None, 1, 5), (503, "b", 10, 9), (504, "a", 7, 7), (504, "a", 7, 7)]
    p = spark.createDataFrame(points, "id long, k string, n long").selectExpr("*", "1 as __at", "2 as interval")
    i = spark.createDataFrame(spans, "id long, k string, start_chapter long, end_chapter long").selectExpr("*", "1 as n")
    holds = lambda x, y: None not in (x[1], x[2], y[1], y[2]) and x[1] == y[1] and y[2] <= x[2] and (not y[3] or y[3] >= x[2])
    want = sorted((x[0], y[0]) for x in points for y in spans if holds(x, y))
    got = valid_rows(p, i, ["k"], "n")
    assert sorted((r.point.id, r.interval.id) for r in got.collect()) == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    left = valid_rows(p, i, ["k"], "n", how="left").collect()
    assert sorted(r.point.id for r in left if r.interval is None) == sorted(x[0] for x in points if not any(holds(x, y) for y in spans))
    assert sorted((r.point.id, r.interval.id) for r in left if r.interval is not None) == want


def test_a_wide_interval_is_a_row_or_two(spark):
    p = spark.range(1000).selectExpr("'k' as k", "id as n")
    wide = spark.createDataFrame([("k", 0, 10**12), ("k", 5, 5), ("k", 990, 0)], "k string, start_chapter long, end_chapter long")
    assert valid_rows(p, wide, ["k"], "n").count() == 1000 + 1 + 10
    assert valid_rows(p, wide.limit(0), ["k"], "n").count() == 0
    assert valid_rows(p, wide.limit(0), ["k"], "n", how="left").count() == 1000
    assert valid_rows(p.limit(0), wide, ["k"], "n").count() == 0
