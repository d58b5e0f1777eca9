"""Exact vector search: scores are cosines, larger is nearer."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 2048  # vectors


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def top(scores: DataFrame, k: int) -> DataFrame:
    """The k best of each query with their rank."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return scores.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _blocks(queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """A row for each block of queries with each block of chunks (of the same group, if the queries have one): lists qs and vs.
    Vectors are not null."""
    own = ["group"] if "group" in queries.columns else []

    def cut(df: DataFrame, key: str, name: str, *columns: str) -> DataFrame:
        piece = F.pmod(F.xxhash64(key), F.lit(max(1, -(-df.count() // BLOCK))))
        return df.withColumn("__piece", piece).groupBy(*own, "__piece").agg(F.collect_list(F.struct(*columns)).alias(name)).drop("__piece")

    q, v = cut(queries, "query_id", "qs", "query_id", "q"), cut(chunks, "vec_id", "vs", "vec_id", "v", "group")
    return (q.join(v, "group") if own else q.crossJoin(v)).select("qs", "vs")


def _scored_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(query_id, scores, vec_ids, groups) of each query with a block; equal vectors have equal scores."""

    def vectors(x: pa.Array) -> np.ndarray:
        return x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1).astype(np.float64)

    for b in batches:
        for i in range(b.num_rows):
            qs, vs = (b.column(c)[i].values for c in range(2))
            q, v = vectors(qs.field("q")), vectors(vs.field("v"))
            ids, groups = (vs.field(c).to_numpy(zero_copy_only=False) for c in ("vec_id", "group"))
            size = np.sqrt((v * v).sum(axis=1))
            for k, x in zip(qs.field("query_id").to_pylist(), q):
                both = size * np.sqrt((x * x).sum())
                yield k, np.divide((v * x).sum(axis=1), both, out=np.zeros(len(v)), where=both > 0), ids, groups


def top_in_blocks(queries: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """The k best of each query (of its group, if it has one) with their rank. queries: (query_id, q [, group]), chunks:
    (vec_id, v, group). Each block of both sides gives its k best, of which the best remain."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for query_id, score, ids, groups in _scored_blocks(batches):
            best = np.lexsort((ids, -score))[:k]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(best), query_id), pa.int64()), pa.array(groups[best], pa.int64()), pa.array(ids[best], pa.int64()), pa.array(score[best])], ["query_id", "group", "vec_id", "score"])

    return top(_blocks(queries, chunks).mapInArrow(run, "query_id long, group long, vec_id long, score double"), k)


def near_counts(queries: DataFrame, chunks: DataFrame, least: float) -> DataFrame:
    """(query_id, hits): how many chunks score ``least`` at least, in blocks; no row for none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for query_id, score, _, _ in _scored_blocks(batches):
            yield pa.RecordBatch.from_pydict({"query_id": pa.array([query_id], pa.int64()), "hits": pa.array([int((score >= least).sum())], pa.int64())})

    return _blocks(queries, chunks).mapInArrow(run, "query_id long, hits long").groupBy("query_id").agg(F.sum("hits").alias("hits")).filter("hits > 0")


def vote(hits: DataFrame) -> DataFrame:
    """(query_id, group): the group with most hits, the least at a tie."""
    n = hits.groupBy("query_id", "group").agg(F.count("*").alias("n"))
    return n.groupBy("query_id").agg(F.max_by("group", F.struct("n", -F.col("group"))).alias("group"))


def vote_search(queries: DataFrame, chunks: DataFrame, *, recall: int = 100, k: int = 5, gate: float = 0.0) -> DataFrame:
    """Two steps: a wide search votes for a group, then the best of that group. gate: least score, none at 0 or below."""
    best = top_in_blocks(queries.join(vote(top_in_blocks(queries, chunks, recall)), "query_id"), chunks, k)
    return best.filter(F.col("score") >= gate) if gate > 0 else best


def not_near(incoming: DataFrame, stored: DataFrame, most: float = 0.95) -> DataFrame:
    """(vec_id, group) of incoming vectors whose nearest stored one of their group isn't nearer than ``most``: in blocks of a
    group's vectors with each other."""
    queries = incoming.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"), "group")
    near = near_counts(queries, stored, float(np.nextafter(most, 2))).select(F.col("query_id").alias("vec_id"))
    return incoming.select("vec_id", "group").join(near, "vec_id", "left_anti")


def reranked(hits: DataFrame, score: Column, k: int) -> DataFrame:
    """Hits in the order of another score, of the search's own where there is none."""
    w = Window.partitionBy("query_id").orderBy(F.desc(F.coalesce("rerank", "score")), "vec_id")
    return hits.withColumn("rerank", score).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
