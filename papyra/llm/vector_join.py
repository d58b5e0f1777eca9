"""Embedding near-dedup by a subspace pigeonhole join.

Unit vectors with cosine >= c are no further apart than 2 - 2c, squared. A fixed random rotation spreads that over all
coordinates, which are split into ``BLOCKS`` blocks, and each block gets the share of the squared distance that its
coordinates are of all: two vectors can't exceed every block's budget and still link. So each block is joined by range on
its own. Its first coordinate is cut into strips as wide as the budget's root, the reach; vectors meet those of their own and
the next strip. There, those within reach of each other in every coordinate of the block are found by bits (``within_reach``), and
are candidates if their squared distance in the block is within the budget. A candidate pair counts in the first block that finds
it, and its cosine, in double precision, decides.

Equal vectors of a label are one class, with a weight. Classes of a strip are dealt to tiles of about ``TILE``, and each
pair of tiles that meets is a unit of its own, so no strip, label or group of near copies is ever whole in one task. A unit
returns, for each class, the weight that it is linked with and one edge of a forest, not its pairs.

Edges: a null label, and a vector that is null, empty, zero or holds a null or non-finite number, link with nothing; vectors
of different lengths don't link; rows with the same id each get their row; a null id counts as a vector, and is kept if its
component has no id.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papyra.llm.components import components
from papyra.llm.shared import table, written

COSINE, BLOCKS, TILE, AXES, SEED = 0.93, 8, 4096, 12, 20240101
#: Rotated coordinates are whole numbers of 1/GRID, so that all units see the same distances; SLACK covers the rounding.
GRID, SLACK = 1 << 20, 1e-4


@cache
def rotation(d: int) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(SEED + d).standard_normal((d, d)))[0]


@cache
def blocks(d: int) -> list[slice]:
    cuts = np.linspace(0, d, min(BLOCKS, d) + 1).astype(int)
    return [slice(i, j) for i, j in zip(cuts.tolist(), cuts[1:].tolist())]


def budget(d: int, block: int, cosine: float) -> float:
    """Of the squared distance, in whole units of the grid."""
    b = blocks(d)[block]
    return ((2 - 2 * cosine) + SLACK) * (b.stop - b.start) / d * GRID * GRID


def unit_vectors(raw: list[bytes], kind: str) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), dtype=kind).reshape(len(raw), -1).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.square(x).sum(axis=1, keepdims=True))


def rotated(u: np.ndarray) -> np.ndarray:
    return np.rint(u @ rotation(u.shape[1]) * GRID)


def strips(r: np.ndarray, cosine: float) -> np.ndarray:
    """The strip of each vector in each block."""
    d = r.shape[1]
    return np.stack([np.floor(r[:, b.start] / np.sqrt(budget(d, k, cosine))) for k, b in enumerate(blocks(d))], axis=1).astype(np.int32)


def _square(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.square(a - b).sum(axis=1)


def within_reach(pa_: np.ndarray, pb: np.ndarray, reach: float, chunk: int = 512) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows that differ by about ``reach`` at most in each of the first ``AXES`` coordinates: a range join on all of
    them at once. Each coordinate of a is cut into cells of a quarter of the reach; a cell has the bits of those rows of b that
    are within reach of it, and a row's partners are the bits that its cells have in common."""
    width, reach = reach / 4, reach * (1 + 1e-9)
    words = -(-len(pb) // 64)
    maps, index = [], []
    for j in range(min(AXES, pa_.shape[1])):
        cells, place = np.unique(np.floor(pa_[:, j] / width), return_inverse=True)
        low = (cells * width)[:, None]
        on = np.zeros((len(cells), 64 * words), dtype=bool)
        on[:, : len(pb)] = (pb[:, j] >= low - reach) & (pb[:, j] <= low + width * (1 + 1e-9) + reach)
        maps.append(np.packbits(on, axis=1, bitorder="little").view(np.uint64))
        index.append(place)
    for i in range(0, len(pa_), chunk):
        common = maps[0][index[0][i : i + chunk]]
        for m, place in zip(maps[1:], index[1:]):
            common &= m[place[i : i + chunk]]
        x, y = np.nonzero(np.unpackbits(common.view(np.uint8), axis=1, bitorder="little"))
        yield x + i, y


def tile_links(a: np.ndarray, b: np.ndarray, block: int, same: bool, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of the unit vectors a and b that link and are first found in this block; a is b if ``same``."""
    d = a.shape[1]
    ra, rb = rotated(a), rotated(b)
    of, most = blocks(d), [budget(d, k, cosine) for k in range(len(blocks(d)))]
    left, right = [], []
    for x, y in within_reach(ra[:, of[block]], rb[:, of[block]], np.sqrt(most[block])) if len(a) and len(b) else ():
        if same:
            x, y = x[y > x], y[y > x]
        for j in range(0, len(x), 1 << 16):
            p, q = x[j : j + (1 << 16)], y[j : j + (1 << 16)]
            near = _square(ra[p, of[block]], rb[q, of[block]]) <= most[block]  # whole numbers: exact
            p, q = p[near], q[near]
            for k in range(block):
                later = _square(ra[p, of[k]], rb[q, of[k]]) > most[k]
                p, q = p[later], q[later]
            ok = np.einsum("ij,ij->i", a[p], b[q]) >= cosine
            left.append(p[ok])
            right.append(q[ok])
    none = np.zeros(0, dtype=np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def least_labels(n: int, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """For each of n nodes the least node of its component under the pairs."""
    label = np.arange(n)
    while True:
        before = label.copy()
        low = np.minimum(label[p], label[q])
        np.minimum.at(label, p, low)
        np.minimum.at(label, q, low)
        label = label[label]
        if np.array_equal(label, before):
            return label


def prepared(vectors: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """(k, label, d, raw, cls): raw is null where the vector links with nothing; cls is the number of (label, vector)."""
    kind = vectors.schema[vector].dataType.elementType
    dtype = "<f4" if isinstance(kind, T.FloatType) else "<f8"

    @F.arrow_udf(T.BinaryType())
    def raw(v: pa.Array) -> pa.Array:
        def one(x: list | None) -> bytes | None:
            if not x or None in x:
                return None
            y = np.array(x, dtype=dtype)
            return y.tobytes() if np.isfinite(y).all() and y.any() else None

        return pa.array([one(x) for x in v.to_pylist()], pa.binary())

    v = vectors.select(F.col(key).alias("k"), F.col(label).alias("label"), F.col(vector).alias("v")).withColumn("raw", F.when(F.col("label").isNotNull(), raw("v")))
    v = v.select("k", "label", F.size("v").alias("d"), "raw", F.when(F.col("raw").isNotNull(), F.xxhash64("label", F.size("v"), "raw")).alias("cls"))
    return written(v, "vectors")


def linked(vectors: DataFrame, *, key: str = "vec_id", vector: str = "embedding", label: str = "label", cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row, see op9."""
    kind = vectors.schema[key].dataType.simpleString()
    dtype = "<f4" if isinstance(vectors.schema[vector].dataType.elementType, T.FloatType) else "<f8"
    rows = prepared(vectors, key, vector, label)
    classes = rows.filter("cls is not null").groupBy("cls").agg(F.first("label").alias("label"), F.first("d").alias("d"), F.first("raw").alias("raw"), F.count("*").alias("w"), F.min("k").alias("least"))

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def strips_of(raw: pa.Array) -> pa.Array:
        data = raw.to_pylist()
        out: list = [None] * len(data)
        by_size: dict[int, list[int]] = {}
        for i, r in enumerate(data):
            by_size.setdefault(len(r), []).append(i)
        for some in by_size.values():
            for i, s in zip(some, strips(rotated(unit_vectors([data[i] for i in some], dtype)), cosine).tolist()):
                out[i] = s
        return pa.array(out, pa.list_(pa.int32()))

    classes = written(classes.withColumn("strips", strips_of("raw")), "vector-classes")
    place = ["label", "d", "block", "strip"]
    each = classes.select("cls", "label", "d", "raw", "w", F.posexplode("strips").alias("block", "strip"))
    count = written(each.groupBy(*place).agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles")), "strip-sizes")
    beside = lambda by, name: count.select("label", "d", "block", (F.col("strip") + by).alias("strip"), F.col("tiles").alias(name))
    count = written(count.join(beside(1, "below"), place, "left").join(beside(-1, "above"), place, "left").fillna(0, ["below", "above"]), "strip-tiles")
    each = each.join(count, place).withColumn("tile", F.pmod(F.xxhash64("cls"), F.col("tiles")).cast("int"))
    # The units of a class: with each tile of its own strip, of the next one, and of the one before (there on the right).
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    strip, tile = F.col("strip"), F.col("tile")
    unit = lambda first, i, j, up, right: F.struct(first.alias("first"), i.cast("int").alias("i"), j.cast("int").alias("j"), F.lit(up).alias("up"), right.alias("right"))
    own = F.transform(upto(F.col("tiles")), lambda j: unit(strip, F.least(tile, j), F.greatest(tile, j), 0, tile > j))
    above = F.transform(upto(F.col("above")), lambda j: unit(strip, tile, j, 1, F.lit(False)))
    below = F.transform(upto(F.col("below")), lambda j: unit(strip - 1, j, tile, 1, F.lit(True)))
    units = each.select("cls", "label", "d", "raw", "w", "block", F.explode(F.concat(own, above, below)).alias("u"))
    units = units.select(F.xxhash64("label", "d", "block", "u.first", "u.i", "u.j", "u.up").alias("unit"), "block", F.expr("u.up = 0 and u.i = u.j").alias("same"), "u.right", "cls", "w", "raw")

    def run(group: pa.Table) -> pa.Table:
        block, same = group["block"][0].as_py(), group["same"][0].as_py()
        side, cls, w = (np.asarray(group[c]) for c in ("right", "cls", "w"))
        u = unit_vectors(group["raw"].to_pylist(), dtype)
        at = np.arange(len(u))
        a, b = (at, at) if same else (np.flatnonzero(~side), np.flatnonzero(side))
        p, q = tile_links(u[a], u[b], block, same, cosine)
        p, q = a[p], b[q]
        links = np.bincount(p, weights=w[q], minlength=len(u)) + np.bincount(q, weights=w[p], minlength=len(u))
        some = np.flatnonzero(links)
        return pa.table({"a": cls[some], "b": cls[least_labels(len(u), p, q)[some]], "links": links[some].astype(np.int64)})

    found = written(units.groupBy("unit").applyInArrow(run, "a long, b long, links long"), "vector-links")
    labels = components(found)
    result = classes.select("cls", "w", "least").join(found.groupBy(F.col("a").alias("cls")).agg(F.sum("links").alias("links")), "cls", "left")
    result = result.join(labels.withColumnRenamed("node", "cls"), "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    result = written(result, "vector-labels")
    least = result.groupBy("label").agg(F.min("least").alias("component_id"))
    result = written(result.join(least, "label").select("cls", (F.col("w") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id"), "vector-components")
    alone = rows.filter("cls is null").select("k", F.lit(0).cast("long").alias("n_links"), F.col("k").alias("component_id"))
    out = rows.filter("cls is not null").select("k", "cls").join(result, "cls").select("k", "n_links", "component_id").unionByName(alone)
    return out.select(F.col("k").cast(kind).alias("vec_id"), "n_links", F.col("component_id").cast("long").alias("component_id"), F.col("k").eqNullSafe(F.col("component_id")).alias("kept"))


def op9_vector_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(table(spark, sf_dir, "embeddings"))
