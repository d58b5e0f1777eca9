import zlib

import numpy as np
from pyspark.sql import functions as F

from papyra.llm import quality as q


def _docs(spark):
    good = "The rain came early. People read quietly, and nobody spoke of it. "
    bad = "BUY!! NOW!! CHEAP!! "
    rows = [(i, (bad if i % 3 == 0 else good) * (3 + i % 5) + f"w{i}", i) for i in range(90)] + [(None, None, 0), (1000, "", 0), (3, bad * 4, 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, score long"), spark.createDataFrame([(i, int(i % 3 != 0)) for i in range(90)] + [(None, 1), (5000, 0), (7, None)], "doc_id long, quality int")


def test_statistics_of_edge_texts():
    for t in (None, "", " \n\t", "x" * 100_000, "\x00"):
        s = q.statistics(t)
        assert len(s) == len(q.STATISTICS) and np.isfinite(s).all()


def test_fit_matches_one_pass_over_all_rows(spark):
    docs, labels = _docs(spark)
    model = q.fit(q.with_statistics(docs), labels)
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id is not None and r.doc_id < 90 and zlib.crc32(str(r.doc_id).encode()) % 5]
    rows = [(k, t) for k, t in rows if k != 7]
    x, y = np.array([q.statistics(t) for _, t in rows]), np.array([int(k % 3 != 0) for k, _ in rows])
    direct = q.solve({k: ((y == k).sum(), x[y == k].sum(0), x[y == k].T @ x[y == k]) for k in (0, 1)})
    np.testing.assert_allclose(model.scores(x), direct.scores(x), atol=1e-6)
    assert ((model.scores(x) >= q.THRESHOLD) == y).all()


def test_mahalanobis_log_density_is_the_gaussian_one():
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=(50, 12)), rng.normal(2, 2, size=(60, 12))
    m = q.solve({0: (50, a.sum(0), a.T @ a), 1: (60, b.sum(0), b.T @ b)}, shrink=0.0, ridge=0.0)
    x = rng.normal(1, 1, size=(5, 12))

    def log(x, z, prior):
        c, d = np.cov(z.T, bias=True), x - z.mean(0)
        return np.log(prior) - 0.5 * np.linalg.slogdet(c)[1] - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(c), d)

    want = 1 / (1 + np.exp(log(x, a, 50 / 110) - log(x, b, 60 / 110)))
    np.testing.assert_allclose(m.scores(x), want, rtol=1e-6)


def test_accepted_keeps_schema_and_clean_rows(spark):
    docs, labels = _docs(spark)
    kept = q.accepted(docs, labels)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert {i for i in range(90) if i % 3} <= set(ids) and not any(i is not None and i < 90 and i % 3 == 0 for i in ids)
    assert q.accepted(docs, labels.limit(0)).count() == docs.count()
    assert q.accepted(docs.limit(0), labels).count() == 0


def test_held_out_rows(spark):
    d = spark.createDataFrame([(i,) for i in range(50)] + [(None,)], "k long").select("k", q.held_out("k").alias("h"))
    assert all(r.h == (r.k is not None and zlib.crc32(str(r.k).encode()) % 5 == 0) for r in d.collect())
    assert d.filter(F.col("h").isNull()).count() == 0
