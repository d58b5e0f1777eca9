import hashlib
import math
import random

import numpy as np

from papyra.llm import elkan as el


def _brute(rows, k=8, dims=64, rounds=10):
    sound = lambda x: x is not None and math.isfinite(x)
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(map(sound, v))]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    c = [v for _, v in order[:k]]
    dist = lambda v, y: sum((a - b) ** 2 for a, b in zip(v, y))
    for step in range(rounds + 1):
        at = [min((dist(v, y), j) for j, y in enumerate(c)) for _, v in kept]
        if step < rounds:
            for j in range(len(c)):
                mine = [v for (_, v), (_, a) in zip(kept, at) if a == j]
                c[j] = [sum(x) // len(mine) for x in zip(*mine)] if mine else c[j]
    return sorted((str(i), a, d) for (i, _), (d, a) in zip(kept, at)), c


def _df(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5).selectExpr("*", "1 as cluster", "2 as v", "3 as row")


def _same(spark, rows, **how):
    found = el.clustered(_df(spark, rows), **how)
    want, c = _brute(rows, **how)
    assert sorted((str(r.row.vec_id), r.cluster, r.distance) for r in found.rows.collect()) == want
    assert found.centroids.tolist() == c
    assert list(found.inertia) == [sum(d for _, a, d in want if a == j) for j in range(len(c))]
    return found, len(want)


def _f32(v):
    return [float(np.float32(x)) for x in v]


def test_clusters_by_brute_force(spark):
    rng = random.Random(1)
    centres = [[rng.gauss(0, 1) for _ in range(64)] for _ in range(12)]
    rows = [(i, _f32(x + rng.gauss(0, 0.2) for x in rng.choice(centres))) for i in range(400)]
    found, n = _same(spark, rows)
    assert found.worked_out < 0.6 * n * 8 * 11  # bounds leave most distances out


def test_ties_copies_and_unsound_vectors(spark):
    rng = random.Random(2)
    grid = [(i, _f32([rng.choice([-1.0, 0.0, 1.0]) / 1024 for _ in range(2)] + [0.0] * 62)) for i in range(150)]  # few places: ties
    rows = grid + [(7, grid[3][1]), (7, grid[3][1]), (None, grid[0][1]), (None, grid[1][1])]
    bad = [(500, None), (501, [1.0] * 63), (502, [float("nan")] + [0.0] * 63), (503, [float("inf")] + [0.0] * 63), (504, [None] + [0.0] * 63), (505, [])]
    _same(spark, rows + bad)
    far = [(600, [3e38] + [0.0] * 63)]  # beyond LARGEST: left out
    assert el.clustered(_df(spark, rows + far)).rows.count() == len(rows)


def test_large_components_stay_exact(spark):
    rows = [(i, _f32([(-1) ** (i + j) * (65_000 - 37 * i - j) for j in range(64)])) for i in range(40)]
    _same(spark, rows)


def test_fewer_vectors_than_centroids_and_none(spark):
    rows = [(i, _f32([i * 0.5] * 64)) for i in range(3)]
    found, _ = _same(spark, rows)
    assert len(found.centroids) == 3
    assert el.clustered(_df(spark, [(1, None)])).rows.count() == 0
    assert el.clustered(_df(spark, [])).rows.count() == 0


def test_other_dimensions(spark):
    rng = random.Random(5)
    _same(spark, [(i, _f32([rng.uniform(-2, 2) for _ in range(3)])) for i in range(200)], dims=3, k=5, rounds=4)


def test_assign_gives_what_all_distances_give():
    rng = np.random.default_rng(4)
    v = rng.integers(-3, 4, (500, 4))
    c = rng.integers(-3, 4, (6, 4))
    a, u, lo = el.first_bounds(len(v), len(c))
    move = el.Move.to(c)
    for _ in range(6):
        el.assign(v, a, u, lo, move)
        d = ((v[:, None, :] - c[None]) ** 2).sum(axis=2)
        assert (a == d.argmin(axis=1)).all()
        assert (np.sqrt(d[np.arange(len(v)), a]) <= u).all() and (lo <= np.sqrt(d)).all()
        after = c + rng.integers(-1, 2, c.shape)
        move, c = el.Move.to(after, c), after
