"""Runs of equal values in a table that is range-sorted by a fingerprint of them.

Rows are dealt by (fingerprint, row), so that a value which a third of all rows have fills as many partitions as it needs, and the
bounds that Spark samples hold no texts. Inside a partition they are sorted by (fingerprint, value, row): equal values stand
together, also where two values share a fingerprint. Only runs with a partition's first or last fingerprint can go on in
another one; ``Edges`` keeps these, a few rows a partition."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


class Edges:
    """What is told of the runs of one partition that have its first or its last fingerprint."""

    def __init__(self) -> None:
        self.first: int | None = None
        self.last: int | None = None
        self.head: list[tuple] = []
        self.tail: list[tuple] = []

    def add(self, h: np.ndarray, starts: np.ndarray, tell: Callable[[int], tuple]) -> None:
        """The next batch: its fingerprints, and the rows where runs begin."""
        if self.first is None:
            self.first = int(h[0])
        of, end = h[starts], int(h[-1])
        if end != self.last:
            self.last, self.tail = end, []
        self.head += [tell(j) for j in starts[of == self.first].tolist()]
        self.tail += [tell(j) for j in starts[of == end].tolist()]

    def told(self) -> list[tuple]:
        return self.head if self.first == self.last else self.head + self.tail


def begins(columns: list[pa.Array], before: list | None) -> np.ndarray:
    """Where a row's values differ from those of the row before it; ``before``: the last row of the batch before."""
    m = len(columns[0])
    new = np.zeros(m, dtype=bool)
    if m > 1:
        for c in columns:
            new[1:] |= pc.not_equal(c.slice(1), c.slice(0, m - 1)).to_numpy(zero_copy_only=False)
    new[0] = before != [c[0].as_py() for c in columns]
    return new
