"""Centroid clustering of integer vectors with Elkan's bounds.

Vectors are turned into whole numbers, floor(scale * x), so that centroids and distances are exact. A vector keeps an upper bound
of the distance to its centroid and a lower bound of that to each centroid. After the centroids have moved, the bounds are
widened by how far they moved; a distance is worked out only if the bounds, and half the distance between the two centroids,
leave it open. Bounds are square roots in double precision, rounded to the safe side by ``_up`` and ``_down``, and pruning is strict: a centroid
that may be as near as the present one is always looked at, so ties go to the smaller number as without bounds. Compared
distances are whole numbers.

Each round is one pass over a written table of (row, vector, cluster, bounds) that writes the next one, with each task's sums of
its clusters in a few rows of the same table. Only the sums of the ``k`` clusters reach the driver; only the ``k`` centroids go out.
No vector is moved between executors; a lost one costs a reread of the round before.

Kept vectors: ``dims`` components, none null or non-finite. Components beyond ``LARGEST`` in size would not leave their squared
distances within 64 bits: such vectors are left out too. Edges: with fewer than ``k`` vectors there are as many centroids; rows
with the same id count one by one, and as starting points in the order of their components; a vector without an id starts no
centroid while others can; a null vector is left out; equal centroids tie, the smaller number wins; an empty table gives an empty
result; other columns pass through in ``row``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papyra.llm.shared import release, row_of, table, written

DIMS, CENTROIDS, ROUNDS, SCALE, SEED = 64, 8, 10, 1024, "3"
#: Of a component, before scaling: 64 squares of the difference of two such, scaled, add up to less than 2^63.
LARGEST = 1 << 16
#: What a square root of a whole number below 2^63, and sums of a few of them, may be off by, and more.
MARGIN = 1e-12


def _up(x: np.ndarray) -> np.ndarray:
    return x * (1 + MARGIN) + MARGIN


def _down(x: np.ndarray) -> np.ndarray:
    return np.maximum(x * (1 - MARGIN) - MARGIN, 0.0)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances, row by row."""
    d = a - b
    return np.einsum("ij,ij->i", d, d)


@dataclass(frozen=True)
class Move:
    """The centroids that vectors are assigned to, and how far each has come since the bounds were made."""

    centroids: np.ndarray
    moved: np.ndarray
    between: np.ndarray  #: half the distance of each two, rounded down
    least: np.ndarray  #: of these, the least of each centroid to another

    @staticmethod
    def to(centroids: np.ndarray, before: np.ndarray | None = None) -> Move:
        k = len(centroids)
        moved = np.zeros(k) if before is None else _up(np.sqrt(squared(centroids, before).astype(float)))
        between = np.array([_down(np.sqrt(squared(centroids, np.broadcast_to(c, centroids.shape)).astype(float)) / 2) for c in centroids]).reshape(k, k)
        np.fill_diagonal(between, np.inf)
        return Move(centroids, moved, between, between.min(axis=1) if k else np.zeros(0))


def assign(v: np.ndarray, a: np.ndarray, upper: np.ndarray, lower: np.ndarray, move: Move) -> int:
    """Brings clusters and bounds up to date in place; the number of distances that were worked out."""
    k, c = len(move.centroids), move.centroids
    np.copyto(upper, _up(upper + move.moved[a]), where=move.moved[a] > 0)
    np.copyto(lower, _down(lower - move.moved), where=(move.moved > 0)[None, :])
    open_ = np.flatnonzero(upper >= move.least[a])
    done, exact = 0, np.full(len(v), -1, dtype=np.int64)  # the exact squared distance to the present centroid, once known
    for j in range(k):
        at = open_[(a[open_] != j) & (upper[open_] >= lower[open_, j]) & (upper[open_] >= move.between[a[open_], j])]
        unknown = at[exact[at] < 0]
        if len(unknown):
            exact[unknown] = squared(v[unknown], c[a[unknown]])
            root = np.sqrt(exact[unknown].astype(float))
            upper[unknown], lower[unknown, a[unknown]] = _up(root), _down(root)
            done += len(unknown)
            at = at[(upper[at] >= lower[at, j]) & (upper[at] >= move.between[a[at], j])]
        if len(at):
            d = squared(v[at], np.broadcast_to(c[j], (len(at), v.shape[1])))
            lower[at, j] = _down(np.sqrt(d.astype(float)))
            done += len(at)
            nearer = (d < exact[at]) | ((d == exact[at]) & (j < a[at]))
            won = at[nearer]
            a[won], exact[won], upper[won] = j, d[nearer], _up(np.sqrt(d[nearer].astype(float)))
    return done


def first_bounds(n: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All in cluster 0, nothing known."""
    return np.zeros(n, dtype=np.int64), np.full(n, np.inf), np.zeros((n, k))


#: v: components as 32-bit numbers; a: cluster; u, l: bounds; d: squared distance; s: a task's sums. Vectors as bytes, as Spark
#: handles arrays number by number.
_STATE = "v binary, a int, u double, l binary, d bigint, s array<bigint>"


def packed(x: np.ndarray) -> pa.Array:
    """Each row's bytes."""
    width = x.dtype.itemsize * x.shape[1]
    at = np.arange(0, len(x) * width + 1, width, dtype=np.int32) if len(x) else np.zeros(1, dtype=np.int32)
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(x))])


def unpacked(column: pa.Array, dtype: type, width: int) -> np.ndarray:
    at = np.frombuffer(column.buffers()[1], dtype=np.int32, count=len(column) + 1, offset=4 * column.offset)
    return np.frombuffer(column.buffers()[2], dtype=dtype, count=len(column) * width, offset=int(at[0])).reshape(len(column), width)


def integers(vectors: DataFrame, *, key: str, vector: str, dims: int, scale: int) -> DataFrame:
    """(row, k, v) of the vectors that are kept."""
    x = F.col(f"row.`{vector}`")
    sound = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) <= float(LARGEST))  # noqa: E731  infinite ones are beyond it too
    kept = vectors.select(row_of(vectors).alias("row")).filter(F.coalesce((F.size(x) == dims) & F.forall(x, lambda c: sound(c.cast("double"))), F.lit(False)))
    return kept.select("row", F.col(f"row.`{key}`").alias("k"), F.transform(x, lambda c: F.floor(F.lit(scale) * c.cast("double"))).alias("v"))


def starts(kept: DataFrame, k: int, seed: str) -> np.ndarray:
    """The ``k`` vectors of the least hashes of their ids."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("k").cast("string")), 256)
    first = kept.select(h.alias("h"), "v").orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()  # k rows
    return np.array([r.v for r in first], dtype=np.int64)


def _stepped(state: DataFrame, move: Move, first: bool, last: bool) -> DataFrame:
    """One assignment of all vectors; each task adds rows (row null) with the sums of its clusters: rows, distances worked out,
    sum of distances (of the last assignment) and the components' sums."""
    k = len(move.centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row_type, dims = None, move.centroids.shape[1]
        sums = np.zeros((k, 3 + dims), dtype=np.int64)
        names = ["row", "v", "a", "u", "l", "d", "s"]
        for b in batches:
            n, row_type = b.num_rows, b.column(0).type
            if not n:
                continue
            if first:
                v = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(n, dims)
                a, u, lo = first_bounds(n, k)
            else:
                v = unpacked(b.column(1), np.int32, dims).astype(np.int64)
                a, u = b.column(2).to_numpy(zero_copy_only=False).astype(np.int64), b.column(3).to_numpy(zero_copy_only=False).copy()
                lo = unpacked(b.column(4), np.float64, k).copy()
            done = assign(v, a, u, lo, move)
            sums[0, 1] += done
            d = squared(v, move.centroids[a]) if last else np.zeros(n, dtype=np.int64)
            for j in range(k):
                mine = a == j
                sums[j, 0] += int(mine.sum())
                sums[j, 2] += int(d[mine].sum())
                sums[j, 3:] += v[mine].sum(axis=0)
            kept = packed(v.astype(np.int32)) if first else b.column(1)
            yield pa.RecordBatch.from_arrays([b.column(0), kept, pa.array(a, pa.int32()), pa.array(u), packed(lo), pa.array(d), pa.nulls(n, pa.list_(pa.int64()))], names)
        if row_type is not None:
            none = [pa.nulls(k, t) for t in (row_type, pa.binary(), pa.float64(), pa.binary(), pa.int64())]
            yield pa.RecordBatch.from_arrays([none[0], none[1], pa.array(range(k), pa.int32()), none[2], none[3], none[4], pa.array(sums.tolist(), pa.list_(pa.int64()))], names)

    return state.mapInArrow(run, T.StructType([T.StructField("row", state.schema["row"].dataType), *T._parse_datatype_string(_STATE).fields]))


def _sums(state: DataFrame, k: int, dims: int) -> np.ndarray:
    at = state.filter("s is not null").select("a", F.posexplode("s").alias("i", "x")).groupBy("a", "i").agg(F.sum("x").alias("x"))
    out = np.zeros((k, 3 + dims), dtype=np.int64)
    for r in at.collect():  # k clusters of dims + 3 numbers
        out[r.a, r.i] = r.x
    return out


@dataclass(frozen=True)
class Clusters:
    """rows: (row, cluster, distance), read from the written ``table``; of each centroid its components, and its vectors' summed
    distances; and how many of all distances were worked out."""

    rows: DataFrame
    table: DataFrame | None
    centroids: np.ndarray
    inertia: tuple[int, ...]
    worked_out: int


def clustered(vectors: DataFrame, *, key: str = "vec_id", vector: str = "embedding", dims: int = DIMS, k: int = CENTROIDS, rounds: int = ROUNDS, scale: int = SCALE, seed: str = SEED) -> Clusters:
    kept = integers(vectors, key=key, vector=vector, dims=dims, scale=scale)
    centroids = starts(kept, k, seed)
    if not len(centroids):
        return Clusters(kept.select("row", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), None, centroids, (), 0)
    state, move, worked_out = kept.select("row", "v"), Move.to(centroids), 0
    for round_ in range(rounds + 1):
        first, last = round_ == 0, round_ == rounds
        before = state if first else state.filter("s is null").select("row", "v", "a", "u", "l")
        after = written(_stepped(before, move, first, last), "clusters")
        sums = _sums(after, len(centroids), dims)
        release(state)
        state, worked_out = after, worked_out + int(sums[0, 1])
        if not last:
            n = sums[:, :1]
            # NumPy's whole-number division rounds down.
            moved = np.where(n > 0, sums[:, 3:] // np.maximum(n, 1), centroids)
            move, centroids = Move.to(moved, centroids), moved
    rows = state.filter("s is null").select("row", F.col("a").alias("cluster"), F.col("d").alias("distance"))
    return Clusters(rows, state, centroids, tuple(sums[:, 2].tolist()), worked_out)


def op12_elkan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = clustered(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    of = lambda values, empty: F.element_at(F.array(*map(F.lit, values)), F.col("cluster") + 1) if values else empty
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in found.centroids.tolist()]
    return found.rows.select(
        F.col("row.vec_id").alias("vec_id"), "cluster", "distance", of(found.inertia, F.lit(0)).cast("long").alias("cluster_inertia"),
        F.lit(sum(found.inertia)).cast("long").alias("inertia"), of(names, F.lit("")).alias("centroid_sha256"),
    )


def _sql() -> str:
    """All rounds one after another: distances to every centroid, the nearest, the mean rounded down."""
    parts = [
        f"""v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, [floor({SCALE} * x::DOUBLE)::BIGINT FOR x IN embedding] AS x FROM embeddings
  WHERE len(embedding) = {DIMS} AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x) AND abs(x) <= {LARGEST}]) = {DIMS})""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id) NULLS LAST, x) - 1 AS c, x AS y FROM v ORDER BY c LIMIT {CENTROIDS})",
    ]
    for i in range(ROUNDS + 1):
        parts.append(f"""a{i} AS MATERIALIZED (
  SELECT r, any_value(vec_id) AS vec_id, any_value(x) AS x, min((d, c)) AS best
  FROM (SELECT r, vec_id, x, c, list_sum([(z[1] - z[2]) * (z[1] - z[2]) FOR z IN list_zip(x, y)])::BIGINT AS d FROM v, c{i}) GROUP BY r)""")
        if i < ROUNDS:
            parts.append(f"""c{i + 1} AS MATERIALIZED (
  SELECT c{i}.c AS c, coalesce(m.y, c{i}.y) AS y FROM c{i} LEFT JOIN (
    SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY j) AS y
    FROM (SELECT best[2] AS c, j, sum(x[j])::BIGINT AS s, count(*) AS n FROM a{i}, range(1, {DIMS + 1}) AS t(j) GROUP BY ALL) GROUP BY c) AS m ON m.c = c{i}.c)""")
    return "WITH " + ",\n".join(parts) + f"""
SELECT vec_id, best[2]::INT AS cluster, best[1] AS distance, (sum(best[1]) OVER (PARTITION BY best[2]))::BIGINT AS cluster_inertia,
       (sum(best[1]) OVER ())::BIGINT AS inertia, sha256(array_to_string(y, ',')) AS centroid_sha256
FROM a{ROUNDS} JOIN c{ROUNDS} ON c = best[2]"""


OP12_SQL = _sql()
