"""Vector search by inverted lists: vectors stand in the list of their nearest centroid, and a query reads the lists of its
nearest centroids only. Scores of what is read are exact cosines; what is in other lists isn't found. ``vector.top_in_blocks``
is the exact search.

Centroids are fitted on a sample of at most about ``SAMPLE`` vectors, picked by the hash of their ids; every vector is indexed.
How many lists a query needs is measured on that sample: the least number with which ``TARGET`` of the sample's nearest
neighbours are found. Lists are stored as blocks of at most some ``BLOCK`` vectors in a table partitioned by list, so that a
search prunes to the lists it needs, shuffles no vector by itself, and a list with a third of all vectors is many blocks."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papyra.operators.vector import BLOCK, _scored_blocks, top

SAMPLE, ROUNDS, SEED, TARGET = 20_000, 15, 7, 0.95
#: Sampled vectors that a list should have at least, for its centroid to mean something; and sampled queries of the tuning.
PER_LIST, TUNED_ON = 39, 400


def unit(x: np.ndarray) -> np.ndarray:
    size = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


def centroids_of(x: np.ndarray, lists: int, rounds: int = ROUNDS, seed: int = SEED) -> np.ndarray:
    """Unit vectors in the middle of ``lists`` groups of unit vectors. A group that loses its members takes the vector that is
    farthest from its own centroid."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), size=min(lists, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = x @ c.T
        at = near.argmax(axis=1)
        far = np.argsort(near[np.arange(len(x)), at], kind="stable")
        sums = np.zeros_like(c)
        np.add.at(sums, at, x)
        empty = np.flatnonzero(np.bincount(at, minlength=len(c)) == 0)
        sums[empty] = x[far[: len(empty)]]
        c = unit(sums)
    return c


def probes_for(x: np.ndarray, c: np.ndarray, k: int, target: float, queries: int = TUNED_ON) -> int:
    """The least number of lists with which ``target`` of the ``k`` nearest of some of x are found among x."""
    q = x[:: max(1, len(x) // queries)]
    near = np.argsort(-(q @ x.T), axis=1, kind="stable")[:, : k + 1]
    rank = np.argsort(np.argsort(-(q @ c.T), axis=1, kind="stable"), axis=1, kind="stable")
    needed = np.sort(rank[np.arange(len(q))[:, None], (x @ c.T).argmax(axis=1)[near]].ravel()) + 1
    return int(needed[min(len(needed) - 1, int(np.ceil(target * len(needed))) - 1)])


@dataclass(frozen=True)
class Lists:
    """blocks: (list, vs) with vs the vectors (vec_id, v, group) of a block, at ``path``."""

    path: str
    centroids: np.ndarray
    probes: int


def _nearest(df: DataFrame, vector: str, c: np.ndarray, n: int) -> DataFrame:
    """Rows of df, once for each of the n nearest centroids of their vector, with its number in ``list``. Vectors that are null
    or of another length go nowhere."""
    dims, names = c.shape[1], [*df.columns, "list"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = unit(b.column(b.schema.get_field_index(vector)).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, dims).astype(np.float64))
            at = np.argsort(-(x @ c.T), axis=1, kind="stable")[:, :n]
            rows = b.take(pa.array(np.repeat(np.arange(b.num_rows), at.shape[1])))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(at.ravel(), pa.int32())], names)

    sound = F.coalesce((F.size(vector) == dims) & F.forall(vector, lambda v: v.isNotNull()), F.lit(False))
    return df.filter(sound).mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("list", T.IntegerType())]))


def built(chunks: DataFrame, path: str, *, lists: int | None = None, k: int = 5, target: float = TARGET, sample: int = SAMPLE) -> Lists:
    """The index of chunks (vec_id, v, group), written to ``path``. lists: about the square root of the number of vectors unless
    told, and no more than the sample can fit."""
    n = chunks.count()
    picked = chunks.filter(F.pmod(F.xxhash64("vec_id", F.lit("ivf")), F.lit(1 << 30)) < max(1, int((1 << 30) * min(1.0, sample / max(n, 1)))))
    rows = [r.v for r in picked.filter("v is not null").select("v").collect()]  # about ``sample`` vectors
    dims = max((len(v) for v in rows), default=1)
    x = unit(np.array([v for v in rows if len(v) == dims and None not in v], dtype=np.float64).reshape(-1, dims))
    c = centroids_of(x, max(1, min(lists or int(np.sqrt(n)), len(x) // PER_LIST))) if len(x) else np.zeros((1, dims))
    probes = probes_for(x, c, k, target) if len(x) else 1
    listed = _nearest(chunks.select("vec_id", "v", "group"), "v", c, 1)
    sizes = listed.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).alias("pieces"))
    pieces = listed.join(F.broadcast(sizes), "list").withColumn("piece", F.pmod(F.xxhash64("vec_id"), F.col("pieces")))  # one row a list
    blocks = pieces.groupBy("list", "piece").agg(F.collect_list(F.struct("vec_id", "v", "group")).alias("vs")).select("vs", "list")
    blocks.write.partitionBy("list").parquet(path)
    return Lists(path, c, probes)


def search(queries: DataFrame, index: Lists, k: int, probes: int | None = None) -> DataFrame:
    """The k best of each query (query_id, q) in the lists of its nearest centroids, with their rank."""
    spark = queries.sparkSession
    asked = _nearest(queries.select("query_id", "q"), "q", index.centroids, min(probes or index.probes, len(index.centroids)))
    wanted = [r.list for r in asked.select("list").distinct().collect()]  # at most one number a list
    piece = F.pmod(F.xxhash64("query_id"), F.lit(max(1, -(-queries.count() // BLOCK))))
    qs = asked.withColumn("piece", piece).groupBy("list", "piece").agg(F.collect_list(F.struct("query_id", "q")).alias("qs"))
    blocks = spark.read.parquet(index.path).filter(F.col("list").isin(wanted))
    met = qs.join(blocks, "list").select("qs", "vs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for query_id, score, ids, groups in _scored_blocks(batches):
            best = np.lexsort((ids, -score))[:k]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(best), query_id), pa.int64()), pa.array(groups[best], pa.int64()), pa.array(ids[best], pa.int64()), pa.array(score[best])], ["query_id", "group", "vec_id", "score"])

    return top(met.mapInArrow(run, "query_id long, group long, vec_id long, score double"), k)


def recall(found: DataFrame, exact: DataFrame) -> float:
    """The share of exact hits (query_id, vec_id) that are found."""
    hits = exact.select("query_id", "vec_id").join(found.select("query_id", "vec_id").withColumn("hit", F.lit(1)), ["query_id", "vec_id"], "left")
    r = hits.agg(F.count("hit").alias("hit"), F.count("*").alias("all")).first()
    return r.hit / r.all if r.all else 1.0
