"""The Spark session that tests, the bench and local work use. On a cluster the session comes from outside."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import SparkSession


def session(name: str = "papyra", *, master: str = "local[*]", partitions: int = 8, memory: str = "4g", **conf: str) -> SparkSession:
    b = SparkSession.builder.master(master).appName(name).config("spark.sql.shuffle.partitions", str(partitions)).config("spark.driver.memory", memory)
    b = b.config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    for k, v in conf.items():
        b = b.config(k, v)
    s = b.getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


#: Rows, and bytes, of an Arrow batch: some megabytes of text, where the default of 10,000 rows would be tens of them for each task.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def small_batches(spark: SparkSession) -> None:
    """From now on this session's Arrow batches have at most ``BATCH_ROWS`` rows and about ``BATCH_BYTES`` bytes."""
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= BATCH_ROWS:
        spark.conf.set(rows, BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, where checkpoints go; only where that is unset, and Spark runs in one process,
    one of our own."""
    sc = spark.sparkContext
    found = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.match(r"local(\[.*\])?$", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="papyra-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found
