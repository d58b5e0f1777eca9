"""Rows into a sink that may fail, such as a vector store: in batches, with retries, and with a table of what failed."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIZE, TRIES, BASE, CAP = 128, 3, 1.0, 30.0

#: A sink takes (the batch's name, its rows). A batch that comes again, after a lost task or in a second run, has the same name
#: and the same rows; a sink that knows names takes it once.
Sink = Callable[[str, pa.RecordBatch], None]


def delays(tries: int, base: float = BASE, cap: float = CAP) -> list[float]:
    """Seconds to wait after each failed try but the last."""
    return [min(base * 2**i, cap) for i in range(tries - 1)]


def _batches(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The same rows, ``size`` at a time."""
    held: list[pa.RecordBatch] = []
    n = 0
    for b in batches:
        at = 0
        while at < b.num_rows:
            some = b.slice(at, size - n)
            held.append(some)
            n, at = n + some.num_rows, at + some.num_rows
            if n == size:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, n = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def delivered(rows: DataFrame, key: str, sink: Sink, path: str, *, size: int = SIZE, tries: int = TRIES, base: float = BASE, cap: float = CAP, partitions: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(counts, failures): every row goes to the sink, ``size`` at a time; a batch that fails is tried again after growing
    delays, and its rows are kept as failures after the last try. Outcomes are a table at ``path`` and are read from there, so
    that looking at them delivers nothing again. counts: ok, n. failures: the rows, with batch, tries and error.

    Batches are made of the rows in the order of their key within a partition of its hash: the same rows make the same
    batches in every run, as long as the number of partitions is the same. Rows that fail are delivered again by a call with them."""
    n = partitions or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    columns = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _batches(batches, size):
            name = hashlib.sha1("\x00".join(map(str, b.column(columns.index(key)).to_pylist())).encode()).hexdigest()
            error, tried = None, 0
            for wait in [*delays(tries, base, cap), None]:
                tried += 1
                try:
                    sink(name, b)
                    error = None
                    break
                except Exception as e:  # whatever a sink raises is a failed try
                    error = f"{type(e).__name__}: {e}"
                    if wait is not None:
                        time.sleep(wait)
            m = b.num_rows
            told = [pa.array([name] * m), pa.array([tried] * m, pa.int32()), pa.array([error] * m, pa.string())]
            yield pa.RecordBatch.from_arrays([pa.StructArray.from_arrays(b.columns, fields=list(b.schema)), *told], ["row", "batch", "tries", "error"])

    ordered = rows.repartition(n, key).sortWithinPartitions(*[key, *[c for c in columns if c != key]])
    ordered.mapInArrow(run, f"row {rows.schema.simpleString()}, batch string, tries int, error string").write.parquet(path)
    out = rows.sparkSession.read.parquet(path)
    counts = out.groupBy(F.col("error").isNull().alias("ok")).agg(F.count("*").alias("n"))
    return counts, out.filter("error is not null").select("row.*", "batch", "tries", "error")
