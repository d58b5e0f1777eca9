"""State by chapter: as-of lookups, validity intervals, changes between neighbours, and lifecycles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def valid_at(n: Column | int, start: str = "start_chapter", end: str = "end_chapter") -> Column:
    """An interval that has begun by n and has not ended before; end 0 or null: still open."""
    return (F.col(start) <= n) & (F.col(end).isNull() | (F.col(end) == 0) | (F.col(end) >= n))


def as_of(df: DataFrame, key: Sequence[str], at: str, n: int, values: Sequence[str]) -> DataFrame:
    """Of each key the values at its latest point up to n: one aggregate, no sort."""
    return df.filter(F.col(at) <= n).groupBy(*key).agg(F.max(at).alias(at), *[F.max_by(v, at).alias(v) for v in values])


def as_of_rows(left: DataFrame, right: DataFrame, key: str, at: str, value: str, *, strict: bool = False) -> DataFrame:
    """For each row of left the value of right at the latest point not after (strict: before) its own, by one shuffle on the
    key: both sides in one order, the last value carried on."""
    other = right.select(key, at, F.struct(F.col(value).alias("v"), F.col(at).cast("long").alias("at")).alias("__r"), F.lit(1 if strict else 0).alias("__left"), F.lit(False).alias("__mine"))
    both = left.withColumns({"__left": F.lit(0 if strict else 1), "__mine": F.lit(True)}).unionByName(other, allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy(at, "__left").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = both.withColumn("__r", F.last("__r", ignorenulls=True).over(w)).filter("__mine")  # rows of left have no __r of their own
    return out.withColumns({f"asof_{value}": F.col("__r.v"), f"asof_{at}": F.col("__r.at")}).drop("__r", "__left", "__mine")


def last_non_empty(c: str, key: Sequence[str], order: Sequence[str]) -> Column:
    """The latest value, so far, that is neither null nor empty."""
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return F.last(F.when(F.col(c) != "", F.col(c)), ignorenulls=True).over(w)


def flips(df: DataFrame, key: Sequence[str], order: Sequence[str], state: str, *, from_empty: bool = False) -> DataFrame:
    """Rows whose state differs from the one before (both not empty; or, from_empty, whatever it was)."""
    before = F.lag(state).over(Window.partitionBy(*key).orderBy(*order))
    df = df.withColumn("before", before).filter((F.col(state) != "") & F.col(state).isNotNull())
    if from_empty:
        return df.filter(F.coalesce("before", F.lit("")) != F.col(state))
    return df.filter(F.col("before").isNotNull() & (F.col("before") != "") & (F.col("before") != F.col(state)))


def out_of_order(df: DataFrame, key: Sequence[str], order: Sequence[str], value: str, *, strict: bool) -> DataFrame:
    """Rows whose value is below the one before (strict: or equal to it); before the first stands -1."""
    before = F.lag(value, 1, -1).over(Window.partitionBy(*key).orderBy(*order))
    df = df.withColumn("before", before)
    return df.filter(F.col(value) <= F.col("before")) if strict else df.filter(F.col(value) < F.col("before"))


#: Observed rows in a task, where their number is known.
TASK = 1_000_000


def relation_intervals(observed: DataFrame, pair: Sequence[str], kind: str, chapter: str, rows: int = 0) -> DataFrame:
    """Intervals of relations that are only known by the chapters that observe them. A pair's relation of some kind goes on
    while each chapter that observes the pair observes that kind too; the next that doesn't ends it, one chapter earlier. The
    pair's last observation leaves it open: end 0. Chapters that don't observe the pair change nothing. Pairs are dealt out once,
    to more tasks the more rows there are (rows: about how many, if known), and all else is done where they are."""
    tasks = max(int(observed.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK))
    seen = observed.select(*pair, kind, chapter).repartition(tasks, *pair).distinct()
    per_pair = Window.partitionBy(*pair).orderBy(chapter)
    seen = seen.withColumns({"nth": F.dense_rank().over(per_pair), "__next": F.lead(chapter).over(per_pair)})
    # Of a chapter's rows the last has the next chapter behind it, the others have their own.
    last = F.max("__next").over(Window.partitionBy(*pair, chapter))
    seen = seen.withColumn("next_chapter", F.when(last > F.col(chapter), last))
    run = F.col("nth") - F.row_number().over(Window.partitionBy(*pair, kind).orderBy("nth"))
    runs = seen.withColumn("run", run).groupBy(*pair, kind, "run")
    return runs.agg(F.min(chapter).alias("start_chapter"), F.coalesce(F.greatest(F.max_by("next_chapter", "nth") - 1, F.lit(0)), F.lit(0)).alias("end_chapter"), F.count("*").alias("observations")).drop("run")


def merge_relations(stored: DataFrame, observed: DataFrame, chapter: int, pair: Sequence[str], kind: str, update: Sequence[str]) -> DataFrame:
    """One chapter's step of the same rules over stored intervals (end 0: open): kinds of observed pairs that are not seen
    again close at the chapter before; seen ones take the new attributes into their earliest open row, their other open rows
    close; kinds without an open row open one. All else stays. Of a kind that is observed twice the greatest attributes count."""
    types = observed.groupBy(*pair, kind).agg(F.max(F.struct(F.lit(0).alias("__n"), *update)).alias("__r"))
    types = types.select(*pair, kind, *[F.col(f"__r.{c}").alias(f"new_{c}") for c in update])
    pairs = observed.select(*pair).distinct().withColumn("pair_seen", F.lit(True))
    is_open = F.col("end_chapter") == 0
    earliest = F.row_number().over(Window.partitionBy(*pair, kind, is_open).orderBy("start_chapter"))
    rows = stored.withColumn("nth", earliest).join(pairs, list(pair), "left").join(types.withColumn("kind_seen", F.lit(True)), [*pair, kind], "left")
    goes_on = is_open & F.col("kind_seen") & (F.col("nth") == 1)
    closes = is_open & F.col("pair_seen") & ~F.coalesce(goes_on, F.lit(False))
    kept = rows.select(*pair, kind, "start_chapter", F.when(closes, F.lit(max(chapter - 1, 0))).otherwise(F.col("end_chapter")).alias("end_chapter"), *[F.when(goes_on, F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) for c in update])
    fresh = types.join(stored.filter(is_open).select(*pair, kind).distinct(), [*pair, kind], "left_anti")
    opened = fresh.select(*pair, kind, F.lit(chapter).alias("start_chapter"), F.lit(0).alias("end_chapter"), *[F.col(f"new_{c}").alias(c) for c in update])
    return kept.unionByName(opened)
