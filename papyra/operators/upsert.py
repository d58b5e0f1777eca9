"""Keyed upserts and guarded state changes, as new snapshots of a table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert(target: DataFrame, source: DataFrame, keys: Sequence[str], update: Sequence[str]) -> DataFrame:
    """The target after the source: rows of known keys take the ``update`` columns from it and keep all others; rows of new
    keys come in whole. Applied twice it changes nothing more."""
    s = source.select(*[F.col(c).alias(f"__{c}") for c in target.columns], F.lit(True).alias("__new"))
    both = target.withColumn("__old", F.lit(True)).join(s, [F.col(k) == F.col(f"__{k}") for k in keys], "full_outer")
    known, incoming = F.col("__old").isNotNull(), F.col("__new").isNotNull()

    def pick(c: str) -> Column:
        return F.when(incoming & (~known | F.lit(c in update)), F.col(f"__{c}")).otherwise(F.col(c)).alias(c)

    return both.select(*[pick(c) for c in target.columns])


def delete_where(target: DataFrame, condition: Column) -> tuple[DataFrame, DataFrame]:
    """(what stays, number removed)."""
    gone = F.coalesce(condition, F.lit(False))
    return target.filter(~gone), target.filter(gone).agg(F.count("*").alias("removed"))


def transition(state: Column, to: str, allowed: Mapping[str, Sequence[str]]) -> tuple[Column, Column]:
    """(new state, whether it changed): to is taken only from states that allow it."""
    ok = state.isin([s for s, targets in allowed.items() if to in targets])
    return F.when(ok, F.lit(to)).otherwise(state), F.coalesce(ok, F.lit(False))


#: Which reviews may follow which.
REVIEW = {"pending": ("confirmed", "fixed", "ignored"), "confirmed": ("fixed", "ignored")}
#: Which chapter states may follow which.
CHAPTER = {"pending": ("processing",), "failed": ("processing", "pending"), "processing": ("done", "failed", "pending")}


def reap(states: DataFrame, now: Column, seconds: int, *, status: str = "status", started: str = "started_at") -> DataFrame:
    """Work whose lease has run out goes back to pending."""
    late = (F.col(status) == "processing") & (F.col(started) < now - F.make_dt_interval(secs=F.lit(seconds)))
    return states.withColumn("reaped", late).withColumn(status, F.when(late, F.lit("pending")).otherwise(F.col(status)))


def job_status(total: Column, done: Column, failed: Column, processing: Column, pending: Column) -> Column:
    return F.when((processing > 0) | (pending > 0), "running").when((total > 0) & (done == total), "done").when(failed > 0, "failed").otherwise("done")


def new_keys(source: DataFrame, known: DataFrame, keys: Sequence[str]) -> DataFrame:
    return source.join(known.select(*keys), list(keys), "left_anti")
