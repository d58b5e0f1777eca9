import math

from papyra.llm import source_mix as sm


def _docs(spark):
    rows = [(i, "w " * (i % 37), f"s{i % 4}") for i in range(400)] + [(None, "a b", None), (None, None, None), (7, "x y z", "s0"), (7, "x y z", "s0"), (900, "", "empty")]
    rows += [(1000 + i, "hot " * 11, "hot") for i in range(300)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 as size", "2 as target", "3 as copies"), rows


def _targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest = total - sum(3 * sizes[s] for s in capped)
        free = sum(weight[s] for s in names if s not in capped)
        target = {s: 3.0 * sizes[s] if s in capped else weight[s] * rest / free for s in names}
        over = {s for s in names if target[s] > 3 * sizes[s] + 1e-9}
        if not over:
            return target
        capped |= over


def test_targets_and_copies(spark):
    docs, rows = _docs(spark)
    sizes: dict = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = _targets(sizes)
    got = [(r.row.doc_id, r.row.source, r.size, r.source_size, r.target, r.copies) for r in sm.systematic_copies(docs).collect()]
    assert len(got) == len(rows) and all(0 <= g[5] <= 3 for g in got)
    largest = max(g[2] for g in got)
    for s in sizes:
        mine = [g for g in got if g[1] == s]
        assert all(g[3] == sizes[s] and math.isclose(g[4], want[s], abs_tol=1e-6) for g in mine)
        assert abs(sum(g[2] * g[5] for g in mine) - want[s]) <= 3 * largest + 1
    again = [(r.row.doc_id, r.row.source, r.size, r.source_size, r.target, r.copies) for r in sm.systematic_copies(docs.repartition(7)).collect()]
    assert sorted(got, key=str) == sorted(again, key=str)


def test_mixed_rows_have_the_columns_of_docs(spark):
    docs, _ = _docs(spark)
    out = sm.mixed(docs)
    assert out.columns == docs.columns and out.count() == sum(r.copies for r in sm.systematic_copies(docs).collect())
    assert sm.mixed(docs.limit(0)).count() == 0


def test_no_python_in_the_plan(spark):
    plan = sm.systematic_copies(_docs(spark)[0])._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
