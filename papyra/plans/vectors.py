"""Vector search over ``embeddings``: labels stand for books, every vector whose id is divisible by 100 for a question."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from papyra.operators import ivf
from papyra.operators import vector as v
from papyra.plans.registry import query
from papyra.session import shared_folder

_SCORES = """q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q, label AS own FROM embeddings WHERE vec_id % 100 = 0),
s AS (SELECT query_id, own, label AS grp, vec_id, list_cosine_similarity(q, embedding::DOUBLE[]) AS score FROM q, embeddings)"""
_TOP = "row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)"


def _questions(t, group: bool = False):
    e = t("embeddings").filter("vec_id % 100 = 0")
    return e.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"), *([F.col("label").alias("group")] if group else []))


def _chunks(t):
    return t("embeddings").select("vec_id", F.col("embedding").alias("v"), F.col("label").alias("group"))


def _out(df):
    return df.select("query_id", F.col("rank").cast("long").alias("rank"), "vec_id", F.col("group").alias("label"), F.round("score", 6).alias("score"))


@query("vector_topk", f"WITH {_SCORES} SELECT query_id, r AS rank, vec_id, grp AS label, round(score, 6) AS score FROM (SELECT *, {_TOP} AS r FROM s) WHERE r <= 5")
def _(t):
    return _out(v.top_in_blocks(_questions(t), _chunks(t), 5))


@query("vector_topk_filtered", f"WITH {_SCORES} SELECT query_id, r AS rank, vec_id, grp AS label, round(score, 6) AS score FROM (SELECT *, {_TOP} AS r FROM s WHERE grp = own) WHERE r <= 5")
def _(t):
    return _out(v.top_in_blocks(_questions(t, True), _chunks(t), 5))


@query("vector_vote_search", f"WITH {_SCORES}, w AS (SELECT *, {_TOP} AS r FROM s), n AS (SELECT query_id, grp, count(*) AS n FROM w WHERE r <= 100 GROUP BY ALL), c AS (SELECT query_id, grp FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, grp) AS k FROM n) WHERE k = 1), b AS (SELECT s.*, {_TOP.replace('query_id', 's.query_id')} AS k FROM s JOIN c ON s.query_id = c.query_id AND s.grp = c.grp) SELECT query_id, k AS rank, vec_id, grp AS label, round(score, 6) AS score FROM b WHERE k <= 5 AND score >= 0.1")
def _(t):
    return _out(v.vote_search(_questions(t), _chunks(t), gate=0.1))


@query("cosine_gate", f"WITH {_SCORES} SELECT query_id, count(*) AS hits FROM s WHERE score >= 0.3 GROUP BY query_id")
def _(t):
    return v.near_counts(_questions(t), _chunks(t), 0.3)


@query("semantic_dedup", "SELECT a.vec_id, a.label FROM embeddings a WHERE a.vec_id % 2 = 1 AND NOT EXISTS (SELECT 1 FROM embeddings b WHERE b.vec_id % 2 = 0 AND a.label = b.label AND list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) > 0.3)")
def _(t):
    c = _chunks(t)
    return v.not_near(c.filter("vec_id % 2 = 1"), c.filter("vec_id % 2 = 0"), 0.3).select("vec_id", F.col("group").alias("label"))


@query("rerank_fallback", f"WITH {_SCORES}, h AS (SELECT *, {_TOP} AS r FROM s), k AS (SELECT *, CASE WHEN vec_id % 3 = 0 THEN NULL ELSE 1.0 / (1 + vec_id) END AS rr FROM h WHERE r <= 20) SELECT query_id, vec_id, n AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(rr, score) DESC, vec_id) AS n FROM k) WHERE n <= 5")
def _(t):
    hits = v.top_in_blocks(_questions(t), _chunks(t), 20)
    rerank = F.when(F.col("vec_id") % 3 != 0, F.lit(1.0) / (1 + F.col("vec_id")))
    return v.reranked(hits, rerank, 5).select("query_id", "vec_id", F.col("rank").cast("long").alias("rank"))


def _indexed(t):
    return ivf.built(_chunks(t), f"{shared_folder(t('embeddings').sparkSession)}/ivf-{uuid.uuid4().hex}")


@query("vector_ivf_topk")
def _(t):
    return _out(ivf.search(_questions(t), _indexed(t), 5))


@query("vector_ivf_recall", "SELECT count(*) * 5 AS hits, true AS enough FROM embeddings WHERE vec_id % 100 = 0")
def _(t):
    """Of the five nearest of every question, how many there are, and whether the lists give nine tenths of them at least."""
    exact = v.top_in_blocks(_questions(t), _chunks(t), 5)
    found = ivf.search(_questions(t), _indexed(t), 5)
    hits = exact.select("query_id", "vec_id").join(found.select("query_id", "vec_id").withColumn("hit", F.lit(1)), ["query_id", "vec_id"], "left")
    return hits.agg(F.count("*").alias("hits"), (F.count("hit") >= F.count("*") * 0.9).alias("enough"))


@query("embed_stub")
def _(t):
    from papyra.functions.embed import embed_of

    return t("documents").select("doc_id", F.transform(embed_of(F.col("text")), lambda x: F.round(x, 5)).alias("embedding"))
