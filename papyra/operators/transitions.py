"""State changes that can't both win: a change names the version of the state that it has seen, and takes effect only if that
is still the state's version. What took effect is a row of a log, from which states can be folded again."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyra.operators.upsert import CHAPTER
from papyra.sources.versioned import Conflict, Versioned

#: Which states of a chapter's work may follow which; what a job's may.
WORK = CHAPTER
JOB = {"pending": ("running", "failed"), "running": ("done", "failed", "pending"), "failed": ("pending", "running")}


@dataclass(frozen=True)
class Transitioned:
    """states: (key, status, version, ...) after the changes; log: (key, version, before, after, change) of those that took
    effect; flags: (change, key, affected, reason) of all."""

    states: DataFrame
    log: DataFrame
    flags: DataFrame


def transitioned(states: DataFrame, changes: DataFrame, key: str, allowed: Mapping[str, Sequence[str]] = WORK, *, status: str = "status") -> Transitioned:
    """states: key, status, version, other columns. changes: change (a name of its own), key, to, seen (the version that it has
    read; null: whatever it is). Of several changes of one state that could take effect the first by name does. A change of an
    unknown key, of another version or to a state that may not follow changes nothing; its flag says why."""
    now = states.select(F.col(key).alias("__key"), F.col(status).alias("__from"), F.col("version").alias("__version"))
    rows = changes.join(now, F.col(key) == F.col("__key"), "left")
    may = F.lit(False)
    for before, after in allowed.items():
        may = may | ((F.col("__from") == before) & F.col("to").isin(*after))
    why = F.when(F.col("__key").isNull(), "unknown").when(F.col("seen").isNotNull() & (F.col("seen") != F.col("__version")), "outdated").when(~F.coalesce(may, F.lit(False)), "not allowed")
    rows = rows.withColumn("__why", why)
    first = rows.filter("__why is null").groupBy(key).agg(F.min("change").alias("__first"))
    rows = rows.join(first, key, "left").withColumn("__why", F.coalesce("__why", F.when(F.col("change") != F.col("__first"), "outdated")))
    won = rows.filter("__why is null").dropDuplicates(["change", key])
    log = won.select(key, (F.col("__version") + 1).alias("version"), F.col("__from").alias("before"), F.col("to").alias("after"), "change")
    new = log.select(F.col(key).alias("__key"), F.col("version").alias("__version"), F.col("after").alias("__to"))
    out = states.join(new, F.col(key) == F.col("__key"), "left")
    value = {status: F.coalesce("__to", status), "version": F.coalesce("__version", "version")}
    out = out.select(*[value[c].alias(c) if c in value else F.col(c) for c in states.columns])
    return Transitioned(out, log, rows.select("change", key, F.col("__why").isNull().alias("affected"), F.col("__why").alias("reason")))


def folded(log: DataFrame, key: str) -> DataFrame:
    """(key, status, version): where the log has brought each state."""
    return log.groupBy(key).agg(F.max_by("after", "version").alias("status"), F.max("version").alias("version"))


def apply(store: Versioned, changes: DataFrame, key: str, name: str, checkpoint: Callable[[DataFrame], DataFrame], allowed: Mapping[str, Sequence[str]] = WORK, *, tries: int = 3) -> DataFrame:
    """Changes of the table ``states`` of a store, with the log in ``transitions``: the flags of all changes. If another batch commits in between, the
    changes are tried again on what it has left, where those that it outdated don't take effect."""
    for left in reversed(range(tries)):
        version = store.version()
        found = transitioned(store.read("states", version), changes, key, allowed)
        log, flags = checkpoint(found.log), checkpoint(found.flags)
        whole = store.read("transitions", version).unionByName(log)
        try:
            store.commit({"states": found.states, "transitions": whole}, expected=version, batch=name)
            return flags
        except Conflict:
            if not left:
                raise
    raise AssertionError
