"""Which intervals hold at which points, by key: a range join of two tables, each pair once.

An interval of length l stands in bins of the least power of two that isn't shorter, of which it touches one or two; a point
looks into its one bin of each width that occurs. So a wide interval is a row or two among wide ones, not a row in every bin
that it covers, and the join is an equality on (key, width, bin)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def valid_rows(points: DataFrame, intervals: DataFrame, key: Sequence[str], at: str, *, start: str = "start_chapter", end: str = "end_chapter", how: str = "inner") -> DataFrame:
    """(point, interval) as rows: every point with each interval of its key that has begun by then and hasn't ended before (end 0
    or null: still open). how: left also keeps points without any, once each, with a null interval. Points that are null or
    have a null in their key are in no interval; intervals that end before they start hold nowhere; a null start never begins.
    Rows that repeat count one by one."""
    names = [f"__k{i}" for i in range(len(key))]
    p = points.select(F.struct(*[points[f"`{c}`"] for c in points.columns]).alias("point"), *[F.col(c).alias(n) for c, n in zip(key, names)], F.col(at).cast("long").alias("__at"))
    open_end = F.coalesce(F.col(end), F.lit(0)) == 0
    last = points.agg(F.max(F.col(at).cast("long"))).first()[0]  # where open intervals are cut off
    i = intervals.select(F.struct(*[intervals[f"`{c}`"] for c in intervals.columns]).alias("interval"), *[F.col(c).alias(n) for c, n in zip(key, names)], F.col(start).cast("long").alias("__a"), F.when(open_end, F.lit(last)).otherwise(F.col(end)).cast("long").alias("__b"))
    i = i.filter("__a <= __b").withColumn("__width", F.length(F.bin(F.col("__b") - F.col("__a"))).cast("int"))
    bins = F.array_distinct(F.array(F.expr("shiftright(__a, __width)"), F.expr("shiftright(__b, __width)")))
    i = i.withColumn("__bin", F.explode(bins))
    widths = [r[0] for r in i.select("__width").distinct().collect()]  # at most 64
    looks = p.withColumn("__width", F.explode(F.array(*map(F.lit, widths)))) if widths else p.withColumn("__width", F.lit(None).cast("int"))
    looks = looks.withColumn("__bin", F.expr("shiftright(__at, __width)"))
    met = looks.join(i, [*names, "__width", "__bin"]).filter("__a <= __at and __at <= __b").select("point", "interval")
    if how == "inner":
        return met
    if how != "left":
        raise ValueError(how)
    # Points are told apart by what they hold; those that repeat are found together.
    found = met.select(F.col("point").alias("__p"), F.lit(True).alias("__found")).distinct()
    alone = p.select("point").join(found, F.col("point").eqNullSafe(F.col("__p")), "left").filter("__found is null").select("point")
    return met.unionByName(alone.withColumn("interval", F.lit(None).cast(met.schema["interval"].dataType)))
