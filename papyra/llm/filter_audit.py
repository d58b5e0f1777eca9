"""Filter interaction audit: what each of several filters removes, in every order that they can be applied in.

One of the filters is exact duplication, settled by sorting: rows are range-sorted by a fingerprint of the text, the full text
and doc_id, and each is compared with its predecessor. What a run of equal texts needs to know of its part in earlier
partitions, their least doc_id, comes from a few rows a partition (see ``runs``). The same pass finds which other filters the
text fails.

A row is then a mask of failed filters, and a part (a source) is 32 masks with three counters each, which add up over rows,
partitions and runs (``counters``, ``merged``). All orders and steps follow from a part's counters by products with fixed
matrices of 600 x 32.

Edges: null text is empty; texts without words fail A only; a null doc_id is smaller than nothing and nothing is smaller than
it, so that row never fails E; rows with the same doc_id and text fail E together or not at all; a null part and the empty one
are the same; several labels of a document count as the greatest of each; labels of no document count nowhere; an empty table
has no parts; other columns are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from papyra.llm.runs import Edges, begins
from papyra.llm.shared import WORD, release, small_batches, table, written

FILTERS = "ABCDE"
WORDS, DISTINCT, UPPERS, SYMBOLS = 50, 65, 5, rb"[#$%&*|]"
_UPPER, _SYMBOL = bytes(range(ord("A"), ord("Z") + 1)), re.compile(SYMBOLS)
COUNTERS = ("n", "good", "toxic")


def text_mask(text: bytes) -> int:
    """Bits of the filters A to D that a text fails."""
    words = text.split()
    n = len(text)
    points = n - len(text.translate(None, bytes(range(0x80, 0xC0)))) if not text.isascii() else 0
    few = len(words) < WORDS
    same = 100 * len(set(words)) < DISTINCT * len(words)
    upper = 100 * (n - len(text.translate(None, _UPPER))) > UPPERS * (n - points)
    return few | same << 1 | upper << 2 | bool(_SYMBOL.search(text)) << 3


def _masks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a sorted partition (h, t, k, part) as (p, run, k, part, mask, later): run counts the runs of equal texts from 0, later
    tells whether the run has a smaller key in this partition. At the end the runs at the partition's edges (mask null), with
    fingerprint, text and least key."""
    part, run, least, last, mask, edges = TaskContext.get().partitionId(), -1, None, None, 0, Edges()
    names = ["p", "run", "k", "part", "mask", "later", "h", "t", "least"]
    for batch in batches:
        m = batch.num_rows
        if not m:
            continue
        h, t, keys = batch.column(0), batch.column(1), batch.column(2).to_pylist()
        new = begins([h, t], last)
        last = [h[m - 1].as_py(), t[m - 1].as_py()]
        runs = run + np.cumsum(new)
        mask_of, later = [], []
        for i, (fresh, k) in enumerate(zip(new.tolist(), keys)):
            if fresh:  # rows with a null key come last in a run
                least, mask = k, text_mask(t[i].as_py().encode())
            mask_of.append(mask)
            later.append(k is not None and least is not None and k > least)
        edges.add(h.to_numpy(), np.flatnonzero(new), lambda j: (int(runs[j]), h[j].as_py(), t[j].as_py(), keys[j]))  # noqa: B023  called at once
        run = int(runs[-1])
        none = [pa.nulls(m, ty) for ty in (pa.int64(), pa.string(), pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array([part] * m, pa.int32()), pa.array(runs, pa.int64()), batch.column(2), batch.column(3), pa.array(mask_of, pa.int32()), pa.array(later), *none], names)
    if told := list(zip(*edges.told())):
        m = len(told[0])
        none = [pa.nulls(m, ty) for ty in (pa.int64(), pa.string(), pa.int32(), pa.bool_())]
        ends = [pa.array(v, ty) for v, ty in zip(told[1:], (pa.int64(), pa.string(), pa.int64()))]
        yield pa.RecordBatch.from_arrays([pa.array([part] * m, pa.int32()), pa.array(told[0], pa.int64()), *none, *ends], names)


_MASKS_SQL = "p int, run long, k long, part string, mask int, later boolean, h long, t string, least long"


def masks(docs: DataFrame, *, text: str = "text", key: str = "doc_id", part: str = "source") -> tuple[DataFrame, DataFrame]:
    """(k, part, mask) for each row of ``docs``: bit i is set if the row fails the filter i of ``FILTERS``; and the written table
    behind it, to release."""
    small_batches(docs.sparkSession)
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.xxhash64(t).alias("h"), t.alias("t"), F.col(key).cast("long").alias("k"), F.coalesce(F.col(part), F.lit("")).alias("part"), F.monotonically_increasing_id().alias("r"))
    by_key = [F.col("k").asc_nulls_last(), "r"]
    dealt = rows.repartitionByRange("h", *by_key).sortWithinPartitions("h", "t", *by_key)
    done = written(dealt.select("h", "t", "k", "part").mapInArrow(_masks, _MASKS_SQL), "masks")
    # A text's runs are in partitions one after another, with growing keys.
    before = Window.partitionBy("h", "t").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    carried = done.filter("mask is null").select("p", "run", F.min("least").over(before).alias("carried")).filter("carried is not null")
    rows = done.filter("mask is not null").select("p", "run", "k", "part", "mask", "later").join(F.broadcast(carried), ["p", "run"], "left")
    smaller = F.col("later") | F.coalesce(F.col("k") > F.col("carried"), F.lit(False))
    return rows.select("k", "part", (F.col("mask") + F.when(smaller, 1 << FILTERS.index("E")).otherwise(0)).alias("mask")), done


def counters(masked: DataFrame, labels: DataFrame, *, key: str = "doc_id") -> DataFrame:
    """(part, mask, n, good, toxic): rows, and how many of them are labelled good and toxic. Added up before anything is dealt
    by part."""
    of = labels.select(F.col(key).cast("long").alias("k"), "quality", "toxic").filter("k is not null").groupBy("k")
    of = of.agg(F.max((F.col("quality") == 1).cast("long")).alias("good"), F.max((F.col("toxic") == 1).cast("long")).alias("toxic"))
    sums = [F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("good", "toxic")]
    return masked.join(of, "k", "left").groupBy("part", "mask").agg(F.count("*").alias("n"), *sums)


def merged(*counted: DataFrame) -> DataFrame:
    """Counters of several tables that don't share texts, as those of their union."""
    every = counted[0]
    for c in counted[1:]:
        every = every.unionByName(c)
    return every.groupBy("part", "mask").agg(*[F.sum(c).cast("long").alias(c) for c in COUNTERS])


def _steps(filters: str) -> tuple[list[tuple[str, int, int]], dict[str, np.ndarray]]:
    """(order, step, filter) of each result row, and for each count the 0/1 matrix from masks to these rows."""
    f = len(filters)
    masks_ = np.arange(1 << f)
    rows, of = [], {k: [] for k in ("kept", "removed", "redundant", "unique")}
    for order in permutations(range(f)):
        before = 0
        for step, x in enumerate(order, 1):
            fails, gone = (masks_ >> x & 1).astype(bool), (masks_ & before) != 0
            before |= 1 << x
            rows.append(("".join(filters[j] for j in order), step, x))
            of["kept"].append((masks_ & before) == 0)
            of["removed"].append(fails & ~gone)
            of["redundant"].append(fails & gone)
            of["unique"].append(masks_ == 1 << x)
    return rows, {k: np.array(v, dtype=np.int64) for k, v in of.items()}


AUDIT_SQL = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def audit(counted: DataFrame, filters: str = FILTERS) -> DataFrame:
    """Every order and step of each part, from its counters (at most 32 rows a part)."""
    f = len(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, of = _steps(filters)
        orders, steps, at = pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.int32()), np.array([r[2] for r in rows])
        for batch in batches:
            for part, masks_ in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                v = np.zeros((len(COUNTERS), 1 << f), dtype=np.int64)
                for m in masks_:
                    v[:, m["mask"]] = [m[c] for c in COUNTERS]
                n, good, toxic = v
                removed = of["removed"] @ n
                share = np.array([removed[at == x].sum() for x in range(f)])
                counts = [of["kept"] @ n, removed, of["redundant"] @ n, of["unique"] @ n, of["removed"] @ good, of["removed"] @ toxic, share[at]]
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(rows), pa.string()), orders, steps, *(pa.array(c) for c in counts)], [c.split()[0] for c in AUDIT_SQL.split(", ")])

    return counted.groupBy("part").agg(F.collect_list(F.struct("mask", *COUNTERS)).alias("m")).mapInArrow(run, AUDIT_SQL)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    masked, behind = masks(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    counted = written(counters(masked, table(spark, sf_dir, "labels")), "audit")
    release(behind)
    return audit(counted)


_LETTERS = ", ".join(f"('{c}', {1 << i})" for i, c in enumerate(FILTERS))
_JOINS = "\n".join(f"  JOIN f AS f{i} ON f{i}.c NOT IN ({', '.join(f'f{j}.c' for j in range(i))})" for i in range(1, len(FILTERS)))
OP11_SQL = rf"""
WITH l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY 1),
d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
m AS (SELECT part, coalesce(l.good, 0) AS good, coalesce(l.toxic, 0) AS toxic,
             (len(w) < {WORDS})::INT + 2 * (100 * len(list_distinct(w)) < {DISTINCT} * len(w))::INT
             + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > {UPPERS} * length(t))::INT + 8 * regexp_matches(t, '{SYMBOLS.decode()}')::INT
             + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::INT AS mask
      FROM d LEFT JOIN l USING (doc_id)),
c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY ALL),
f(c, b) AS (VALUES {_LETTERS}),
o AS (SELECT {' || '.join(f'f{i}.c' for i in range(len(FILTERS)))} AS filter_order, [{', '.join(f'f{i}.b' for i in range(len(FILTERS)))}] AS bits FROM f AS f0
{_JOINS}),
s AS (SELECT filter_order, step::INT AS step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS before FROM o, range(1, {len(FILTERS) + 1}) AS r(step)),
x AS (SELECT part, filter_order, step, bit,
             sum(n) FILTER (mask & (before | bit) = 0) AS kept, sum(n) FILTER (mask & bit > 0 AND mask & before = 0) AS removed,
             sum(n) FILTER (mask & bit > 0 AND mask & before > 0) AS redundant, sum(n) FILTER (mask = bit) AS unique_fails,
             sum(good) FILTER (mask & bit > 0 AND mask & before = 0) AS good_lost, sum(toxic) FILTER (mask & bit > 0 AND mask & before = 0) AS toxic_lost
      FROM c, s GROUP BY ALL)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
       coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
       coalesce(sum(removed) OVER (PARTITION BY part, bit), 0)::BIGINT AS shapley
FROM x"""
