"""Browsing, joins, dedup and aggregates that the queries share."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyra.functions.text import EMAIL, PHONE

#: kind of filter -> condition on a column
KINDS = {
    "like": lambda c, v: c.like(f"%{v}%"),
    "eq": lambda c, v: c == v,
    "ge": lambda c, v: c >= v,
    "le": lambda c, v: c <= v,
}


def all_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def page_bounds(limit: object = None, offset: object = None) -> tuple[int, int]:
    """A page's limit, 1 to 100 with 20 for none or 0, and offset; what can't be read is the first page of 20."""
    try:
        return max(1, min(int(limit or 20), 100)), max(0, int(offset or 0))
    except (TypeError, ValueError):
        return 20, 0


def browse(df: DataFrame, filters: Mapping[str, tuple[str, Sequence[str]]], given: Mapping[str, object], order: Sequence[Column], *, limit: object = None, offset: object = None) -> tuple[DataFrame, DataFrame]:
    """(total, page): filters maps a parameter to its kind and columns (several: any of them); blank parameters filter nothing.
    ``%`` and ``_`` in a value are wildcards. order should end in a unique key."""
    used = [any_of([KINDS[kind](F.col(c), given[name]) for c in columns]) for name, (kind, columns) in filters.items() if given.get(name) not in (None, "")]
    found = df.filter(all_of(used))
    n, skip = page_bounds(limit, offset)
    return found.agg(F.count("*").alias("total")), found.orderBy(*order).offset(skip).limit(n)


def optional(df: DataFrame, **equal: object) -> DataFrame:
    """Equality on each column whose value is not None."""
    return df.filter(all_of([F.col(c) == v for c, v in equal.items() if v is not None]))


def first_per_key(df: DataFrame, keys: Sequence[str | Column], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in the given order (a dedup that keeps the first)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rank", F.row_number().over(w)).filter("__rank = 1").drop("__rank")


def any_name(names: Sequence[str], *columns: str) -> Column:
    """One of the names stands in one of the columns; without names, all rows are meant."""
    return any_of([KINDS["like"](F.col(c), n) for n in names for c in columns]) if names else F.lit(True)


def numbered(df: DataFrame, key: str, order: str, width: int = 1 << 16) -> DataFrame:
    """Rows numbered from 1 within each key, in the order of a whole number that is unique in it. Each key is cut into ranges
    of ``width``, so that no key is sorted in one task; only the ranges' counts are added up by key."""
    df = df.withColumn("__range", F.floor(F.col(order) / width))
    before = Window.partitionBy(key).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    counts = df.groupBy(key, "__range").agg(F.count("*").alias("__c")).withColumn("__before", F.coalesce(F.sum("__c").over(before), F.lit(0))).drop("__c")
    within = F.row_number().over(Window.partitionBy(key, "__range").orderBy(order))
    return df.withColumn("n", within).join(counts, [key, "__range"]).withColumn("n", F.col("n") + F.col("__before")).drop("__range", "__before")


def registered(users: DataFrame, known: DataFrame) -> DataFrame:
    """users (phone, email) with ``refused``: neither is given, one of them isn't well formed, or one is known already."""
    phone, email = F.col("phone"), F.col("email")
    out = users
    for c in ("phone", "email"):
        out = out.join(known.filter(F.col(c).isNotNull()).select(c).distinct().withColumn(f"__{c}", F.lit(True)), c, "left")
    why = F.when(phone.isNull() & email.isNull(), "none").when(~phone.rlike(PHONE), "phone").when(~email.rlike(EMAIL), "email").when(F.col("__phone") | F.col("__email"), "taken")
    return out.withColumn("refused", why).drop("__phone", "__email")


def repeated(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def or_default(c: Column, default: object) -> Column:
    """The default where the value is null, zero or empty."""
    return F.when(c.isNull() | c.cast("string").isin("", "0", "0.0", "false"), F.lit(default)).otherwise(c)


def is_empty(c: Column) -> Column:
    """Null, empty text or an empty JSON list."""
    return c.isNull() | F.trim(c).isin("", "[]")


def counts_with_zeros(inputs: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Count of ``found`` for each input key, 0 for those without."""
    n = found.groupBy(key).agg(F.count("*").alias("n"))
    return inputs.select(key).distinct().join(n, key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n"))


def percent(done: Column, total: Column) -> Column:
    return F.when(total > 0, F.least(F.round(done / total * 100), F.lit(100.0))).otherwise(F.lit(0.0)).cast("long")


def earliest_term(text: Column, terms: Sequence[str]) -> Column:
    """(position from 0, term) of the term that stands first in the text; null without any."""
    at = [F.when(F.instr(text, t) > 0, F.struct((F.instr(text, t) - 1).alias("position"), F.lit(i).alias("i"), F.lit(t).alias("term"))) for i, t in enumerate(terms)]
    return F.array_min(F.filter(F.array(*at), lambda x: x.isNotNull())) if at else F.lit(None)


def longest_term(text: Column, terms: Sequence[str]) -> Column:
    """The longest term that the text contains; of equally long ones the first given."""
    order = sorted(dict.fromkeys(t.strip() for t in terms if len(t.strip()) >= 2), key=len, reverse=True)
    return F.coalesce(*[F.when(F.contains(text, F.lit(t)), F.lit(t)) for t in order]) if order else F.lit(None).cast("string")


def window_around(text: Column, position: Column, width: int = 200) -> Column:
    """(text, start, end): so many characters before and after a position, within the text."""
    start, end = F.greatest(position - width, F.lit(0)), F.least(position + width, F.length(text))
    return F.struct(F.substring(text, start + 1, end - start).alias("text"), start.cast("long").alias("start"), end.cast("long").alias("end"))
