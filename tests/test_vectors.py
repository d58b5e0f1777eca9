import numpy as np
import pytest

from papyra.operators import vector as v
from papyra.plans import catalogue


def test_searches_take_every_hundredth_vector(spark, tmp_path):
    rows = [(i, [float((i * 7 + j * j) % 11 - 5) for j in range(4)], i % 3) for i in range(1050)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = catalogue.QUERIES["vector_topk"](spark, str(tmp_path)).collect()
    assert {r.query_id for r in got} == set(range(0, 1050, 100)) and len(got) == 55


@pytest.mark.parametrize("group", [False, True])
def test_blocks_give_what_all_pairs_give(spark, monkeypatch, group):
    monkeypatch.setattr(v, "BLOCK", 16)
    rows = [(i, [float((i * 7 + j * j) % 11 - 5) for j in range(4)] if i % 40 else [0.0] * 4, i % 3) for i in range(120)]
    c = spark.createDataFrame(rows, "vec_id long, v array<float>, group long")
    q = c.filter("vec_id < 25").selectExpr("vec_id as query_id", "v as q", *(["group"] if group else []))
    unit = lambda x: np.array(x) / (np.linalg.norm(x) or 1)
    want, counts = [], []
    for i, x, g in rows[:25]:
        scores = sorted((-round(float(unit(x) @ unit(y)), 9), j, h) for j, y, h in rows if not group or h == g)
        want += [(i, k, h, round(-s, 6) + 0.0) for k, (s, _, h) in enumerate(scores[:7], 1)]
        counts += [(i, n)] if (n := sum(-s >= 0.3 for s, _, _ in scores)) else []
    got = sorted((r.query_id, r["rank"], r.group, round(r.score, 6) + 0.0) for r in v.top_in_blocks(q, c, 7).collect())
    assert [(a, b, d) for a, b, _, d in got] == [(a, b, d) for a, b, _, d in sorted(want)]
    assert sorted(map(tuple, v.near_counts(q, c, 0.3).collect())) == sorted(counts)
    incoming, stored = c.filter("vec_id % 2 = 1"), c.filter("vec_id % 2 = 0")
    kept = [i for i, x, g in rows if i % 2 and not any(float(unit(x) @ unit(y)) > 0.9 for j, y, h in rows if j % 2 == 0 and h == g)]
    assert sorted(r.vec_id for r in v.not_near(incoming, stored, 0.9).collect()) == kept
