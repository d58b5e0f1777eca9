"""Connected components of a graph given as edges, by min-label hops and pointer jumping."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyra.llm.shared import alike, release, written


class Forest:
    """Union-find over the numbers that it meets; a root is the least of its tree."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, v: int) -> int:
        up = self.up
        r = v
        while (n := up.get(r, r)) != r:
            r = n
        while v != r:
            up[v], v = r, up.get(v, v)
        return r

    def link(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        for x, y in np.unique(np.stack([a, b], axis=1), axis=0).tolist() if len(a) else ():
            self.link(x, y)

    def rows(self) -> pa.RecordBatch:
        nodes = list(self.up)
        return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([self.root(v) for v in nodes], pa.int64())], ["a", "b"])


#: Nodes that a task holds before it passes on what it has.
HELD = 300_000


def contracted(edges: DataFrame) -> DataFrame:
    """(a, b): what each task's edges connect, with about one edge for each node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        for batch in batches:
            forest.add(np.asarray(batch.column(0)), np.asarray(batch.column(1)))
            if len(forest.up) > HELD:
                yield forest.rows()
                forest = Forest()
        yield forest.rows()

    return edges.select("a", "b").mapInArrow(run, "a long, b long")


def components(edges: DataFrame, *, most: int = 60) -> DataFrame:
    """(node, label) for each node of the edges (a, b): label is its component's least node. All labels take their neighbours'
    least and then their label's label, so that chains halve in each round. First, tasks drop what their edges say twice;
    and again, as fewer tasks then hold what is left. Each table goes when the next one is there."""

    def then(next_: DataFrame, *gone: DataFrame) -> DataFrame:
        release(*gone)
        return next_

    once = written(contracted(edges), "edges-once")
    edges = then(written(contracted(once).filter("a <> b").distinct(), "edges"), once)
    both = then(written(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges-both"), edges)
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("label")), "labels")
    for _ in range(most):
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        near = then(written(labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label")), "labels-near"), labels)
        jump = near.select(F.col("node").alias("label"), F.col("label").alias("far"))
        labels = then(written(near.join(jump, "label").select("node", F.col("far").alias("label"), (F.col("far") != F.col("old")).alias("moved")), "labels"), near)
        if labels.filter("moved").isEmpty():
            release(both)
            return alike(labels.select("node", "label"), labels)
    raise RuntimeError(f"components didn't settle in {most} rounds")
