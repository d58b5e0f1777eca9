import numpy as np

from papyra.operators import ivf
from papyra.operators import vector as v


def _table(spark, n=1500, seed=2):
    g = np.random.default_rng(seed)
    middle = g.normal(size=(10, 16))
    at = np.where(g.random(n) < 0.35, 0, g.integers(0, 10, n))  # one place holds a third
    x = middle[at] + 0.3 * g.normal(size=(n, 16))
    rows = [(i, y.astype(np.float32).tolist(), int(a)) for i, (y, a) in enumerate(zip(x, at))]
    return spark.createDataFrame([*rows, (n, None, 0), (n + 1, [0.0] * 16, 0), (n + 2, [1.0] * 3, 0), (n + 3, rows[0][1], 5)], "vec_id long, v array<float>, group long").repartition(3)


def test_recall_of_lists_and_pruning(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ivf, "BLOCK", 100)
    chunks = _table(spark)
    queries = chunks.filter("vec_id % 50 = 0 and size(v) = 16").selectExpr("vec_id as query_id", "v as q")
    index = ivf.built(chunks, str(tmp_path / "ivf"), lists=12)
    blocks = spark.read.parquet(index.path).selectExpr("list", "size(vs) as n")
    assert blocks.selectExpr("sum(n)").first()[0] == 1502  # all but null and one of another length
    assert blocks.groupBy("list").count().selectExpr("max(count)").first()[0] > 1 and blocks.selectExpr("max(n)").first()[0] < 200
    exact = v.top_in_blocks(queries, chunks.filter("size(v) = 16"), 5)
    found = ivf.search(queries, index, 5)
    assert ivf.recall(found, exact) >= 0.9 and index.probes < 12
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert any("list#" in line.split("PartitionFilters:")[1].split("PushedFilters")[0] for line in plan.splitlines() if "PartitionFilters:" in line)
    whole = ivf.search(queries, index, 5, probes=12)
    same = lambda df: sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in df.collect())
    assert same(whole) == same(exact)


def test_few_vectors_and_none(spark, tmp_path):
    one = spark.createDataFrame([(1, [1.0, 0.0], 0), (2, [0.0, 1.0], 0)], "vec_id long, v array<float>, group long")
    q = spark.createDataFrame([(9, [1.0, 0.1])], "query_id long, q array<float>")
    assert [r.vec_id for r in ivf.search(q, ivf.built(one, str(tmp_path / "a")), 1).collect()] == [1]
    empty = ivf.built(one.limit(0), str(tmp_path / "b"))
    assert len(empty.centroids) == 1


def test_centroids_without_empty_groups():
    x = ivf.unit(np.array([[1.0, 0.0]] * 30 + [[0.0, 1.0]] * 30))
    c = ivf.centroids_of(x, 2)
    assert sorted(np.bincount((x @ c.T).argmax(axis=1), minlength=2).tolist()) == [30, 30]
