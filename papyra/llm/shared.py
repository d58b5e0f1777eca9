"""Helpers that several operators of this package use."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words: the six ASCII white-space characters. Same as Python's ``bytes.split()``.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; only where that is unset, and Spark runs in one process (as in tests), one
    of our own."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[.*\])?$", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="papyra-")
        spark.sparkContext.setCheckpointDir(found)
    return found


#: Rows of text in an Arrow batch: some megabytes, where the default of 10,000 would be tens of them for each task.
BATCH_ROWS = 2000


def small_batches(spark: SparkSession) -> None:
    """From now on this session's Arrow batches have at most ``BATCH_ROWS`` rows."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


#: Paths of the tables that this process has written, until they are discarded; and of the frames that read them.
WRITTEN: list[str] = []
_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
#: While a table is written: its shuffles go when it is there, as no other plan reads them.
_WHILE = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


@contextmanager
def once(spark: SparkSession) -> Iterator[None]:
    """What runs in here leaves no shuffles behind: no later plan may read them."""
    before = {k: spark.conf.get(k, None) for k in _WHILE}
    try:
        for k, v in _WHILE.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: lineage ends there, and a lost executor costs a reread."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    WRITTEN.append(path)
    with once(spark):
        df.write.parquet(path)
    return alike(spark.read.schema(df.schema).parquet(path), path)


def alike(df: DataFrame, of: DataFrame | str) -> DataFrame:
    """``df``, which reads the table of ``of``: releasing it releases that."""
    _PATHS[df] = of if isinstance(of, str) else _PATHS[of]
    return df


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def release(*tables: DataFrame) -> None:
    """Deletes tables that ``written`` made, when all that reads them is written."""
    for t in tables:
        if (path := _PATHS.get(t)) in WRITTEN:
            WRITTEN.remove(path)
            _delete(t.sparkSession, path)


def discard(spark: SparkSession, since: int = 0, but: tuple[DataFrame, ...] = ()) -> None:
    """Deletes the tables written since so many were there, ``but`` some. Results that were not stored elsewhere can't be read
    any more."""
    keep = {_PATHS[t] for t in but}
    for path in [p for p in WRITTEN[since:] if p not in keep]:
        WRITTEN.remove(path)
        _delete(spark, path)


def row_of(df: DataFrame) -> Column:
    """All columns of ``df`` in one struct, so that names of our own can't clash with them."""
    return F.struct(*[df[f"`{c}`"] for c in df.columns])


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
