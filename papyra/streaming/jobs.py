"""Streams: progress of jobs, leases, dedup across uploads, relation state, and event-time windows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def files(spark: SparkSession, path: str, like: DataFrame, *, per_trigger: int = 50) -> DataFrame:
    """A stream of the Parquet files that come into a folder."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def progress(events: DataFrame, job: str, state: str) -> DataFrame:
    """Running counts by job and state (update or complete mode)."""
    return events.groupBy(job, state).agg(F.count("*").alias("n"))


def daily_use(events: DataFrame, user: str, ts: str, *, late: str = "1 day") -> DataFrame:
    return events.withWatermark(ts, late).groupBy(F.window(ts, "1 day"), user).agg(F.count("*").alias("n"))


def windowed(events: DataFrame, ts: str, value: str, *, size: str = "1 hour", slide: str | None = None, late: str = "1 day") -> DataFrame:
    """Tumbling, or with ``slide`` sliding, windows."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    return events.withWatermark(ts, late).groupBy(w).agg(F.count("*").alias("n"), F.sum(value).alias("total"))


def sessions(events: DataFrame, user: str, ts: str, *, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    return events.withWatermark(ts, late).groupBy(F.session_window(ts, gap), user).agg(F.count("*").alias("n"))


def once(events: DataFrame, keys: Sequence[str], ts: str, *, late: str = "1 day") -> DataFrame:
    """The first row of each key, as far as the watermark remembers."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(list(keys))


def append_new(batch: DataFrame, path: str, keys: Sequence[str], content: str) -> None:
    """For foreachBatch: adds to the table what it doesn't hold yet, by keys and the hash of the content."""
    spark = batch.sparkSession
    batch = batch.withColumn("content_hash", F.md5(content)).dropDuplicates([*keys, "content_hash"])
    try:
        stored = spark.read.parquet(path)
    except Exception as e:  # no table yet
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        stored = batch.limit(0)
    batch.join(stored.select(*keys, "content_hash"), [*keys, "content_hash"], "left_anti").write.mode("append").parquet(path)


RELATION = "source long, target long, kind string, start_chapter long, end_chapter long"


def _observe(intervals: list[list], chapter: int, kinds: set[str]) -> None:
    """What a chapter that observes these kinds of a pair makes of its intervals [kind, start, end]; end 0: goes on."""
    for x in intervals:
        if x[2] == 0 and x[0] not in kinds:
            x[2] = max(chapter - 1, 0)
    running = {x[0] for x in intervals if x[2] == 0}
    intervals += [[k, chapter, 0] for k in sorted(kinds - running)]


def relation_state(observed: DataFrame) -> DataFrame:
    """The intervals of each pair of (source, target, kind, chapter), kept as state and told anew when a chapter changes
    them. A pair's chapters must come in order, later ones in later or the same batches."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        intervals = [list(x) for x in zip(*state.get)] if state.exists else []
        rows = pd.concat(list(batches))
        for chapter, some in sorted(rows.groupby("chapter")):
            _observe(intervals, int(chapter), set(some["kind"]))
        columns = [list(c) for c in zip(*intervals)]
        state.update(tuple(columns))
        yield pd.DataFrame({"source": key[0], "target": key[1], "kind": columns[0], "start_chapter": columns[1], "end_chapter": columns[2]})

    return observed.groupBy("source", "target").applyInPandasWithState(step, RELATION, "kinds array<string>, starts array<long>, ends array<long>", "update", "NoTimeout")


class _InOrder(StatefulProcessor):
    """A pair's rows wait in a list until the watermark has passed them; then they are taken in the order of their chapters."""

    def __init__(self, forget: int) -> None:
        self.forget = forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, chapter long, kind string")
        self.known = handle.getValueState("known", "kinds array<string>, starts array<long>, ends array<long>, last long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for some in rows:
            at = (some["at"].astype("datetime64[us]").astype("int64") // 1000).tolist()
            self.waiting.appendList(list(zip(at, some["chapter"].tolist(), some["kind"].tolist())))
            for t in set(at):
                self.handle.registerTimer(t)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        rows = sorted(self.waiting.get()) if self.waiting.exists() else []
        due, later = [r for r in rows if r[0] <= now], [r for r in rows if r[0] > now]
        kinds, starts, ends, last = self.known.get() if self.known.exists() else ([], [], [], 0)
        if not due:
            if not later and last + self.forget <= now:  # the pair hasn't been seen for long enough
                self.known.clear()
                self.waiting.clear()
            return iter(())
        intervals = [list(x) for x in zip(kinds, starts, ends)]
        for chapter in sorted({r[1] for r in due}):
            _observe(intervals, chapter, {r[2] for r in due if r[1] == chapter})
        last = max(last, due[-1][0])
        columns = [list(c) for c in zip(*intervals)]
        self.known.update((*columns, last))
        self.waiting.put(later) if later else self.waiting.clear()
        self.handle.registerTimer(last + self.forget)
        return iter([pd.DataFrame({"source": key[0], "target": key[1], "kind": columns[0], "start_chapter": columns[1], "end_chapter": columns[2]})])

    def close(self) -> None:
        pass


def ordered_relation_state(observed: DataFrame, *, late: str = "1 day", forget: int = 30 * 86_400_000) -> DataFrame:
    """``relation_state`` for rows that come in any order, up to ``late``: (source, target, kind, chapter, at), of which ``at`` grows
    with the chapters. What is told of a pair is as of the watermark. A pair that hasn't been seen for ``forget`` milliseconds
    of event time leaves no state behind; seen again, it begins anew. Rows behind the watermark are dropped, as by any
    watermark. Needs the RocksDB state store."""
    seen = observed.withWatermark("at", late).select("source", "target", "kind", "chapter", "at")
    return seen.groupBy("source", "target").transformWithStateInPandas(_InOrder(forget), RELATION, "Update", "EventTime")


LEASE = "job string, chapter long, status string"


def leases(claims: DataFrame, *, seconds: int = 1800) -> DataFrame:
    """(job, chapter, status) for each change: claimed work that isn't finished in time goes back to pending.
    claims: job, chapter, status, at; the latest of a batch counts, and one older than what is known doesn't."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            status, at = "pending", state.get[1]
            state.update((status, at))
        else:
            rows = pd.concat(list(batches))
            at, status = max(zip(rows["at"], rows["status"]))
            at = int(at)
            if state.exists and at < state.get[1]:
                return
            state.update((str(status), at))
            if status == "processing":
                state.setTimeoutDuration(seconds * 1000)
        yield pd.DataFrame({"job": [key[0]], "chapter": [key[1]], "status": [status]})

    return claims.groupBy("job", "chapter").applyInPandasWithState(step, LEASE, "status string, at long", "update", "ProcessingTimeTimeout")
