import numpy as np

from papyra.llm import vector_join as vj
from papyra.llm.components import Forest


def _rows(kind=float):
    r = np.random.default_rng(4)
    base = r.normal(size=(40, 16))
    x = np.concatenate((base, base[:10] + r.normal(size=(10, 16)) * 0.15, base[:10] * 3, base[:3], np.repeat(base[:1], 30, 0) + r.normal(size=(30, 16)) * 0.2))
    rows = [(i, v.astype(np.float32 if kind is float else np.float64).tolist(), i % 3) for i, v in enumerate(x)]
    rows += [(500, None, 1), (501, [0.0] * 16, 1), (502, [float("nan")] * 16, 1), (503, [None] + [1.0] * 15, 1), (504, [float("inf")] * 16, 1), (505, rows[0][1], None), (506, rows[0][1], None), (507, [], 0), (508, [1.0, 2.0], 0), (509, [2.0, 4.0], 0), (0, rows[0][1], 0), (None, rows[0][1], 0), (None, [1.0] * 16, 9)]
    return rows


def _brute(rows):
    def ok(v):
        return v and None not in v and np.isfinite(v).all() and any(v)

    f, n = Forest(), [0] * len(rows)
    for i, (_, v, a) in enumerate(rows):
        for j, (_, w, b) in enumerate(rows[:i]):
            if a is not None and a == b and ok(v) and ok(w) and len(v) == len(w) and np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w) >= vj.COSINE:
                f.link(i, j)
                n[i] += 1
                n[j] += 1
    out = []
    for i, (k, _, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if f.root(j) == f.root(i) and rows[j][0] is not None]
        c = min(ids) if ids else None
        out.append((k, n[i], c, k == c))
    return sorted(out, key=str)


def test_same_as_all_pairs(spark):
    for kind in ("float", "double"):
        rows = _rows(float if kind == "float" else int)
        frame = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int").selectExpr("*", "1 as cls", "2 as raw", "3 as strip")
        assert sorted(map(tuple, vj.linked(frame).collect()), key=str) == _brute(rows)
        assert vj.linked(frame.limit(0)).count() == 0


def test_tiles_meet_whatever_their_size(spark, monkeypatch):
    monkeypatch.setattr(vj, "TILE", 3)
    rows = _rows()
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    assert sorted(map(tuple, vj.linked(frame).collect()), key=str) == _brute(rows)


def test_rotation_keeps_distances_and_budgets_cover():
    q = vj.rotation(24)
    np.testing.assert_allclose(q @ q.T, np.eye(24), atol=1e-12)
    assert abs(sum(vj.budget(24, k, 0.93) for k in range(len(vj.blocks(24)))) / vj.GRID**2 - (0.14 + vj.SLACK)) < 1e-9
    assert len(vj.blocks(3)) == 3
