"""Exact dedup by deterministic block naming.

A text, less the six ASCII white-space characters, is cut into blocks of ``BLOCK`` bytes of UTF-8. All blocks of all texts are
sorted and named by their run among equal ones; then adjacent names of a text are paired, the pairs are sorted and named in the
same way, and so on until a text has one name. Names are places in a sort of the values themselves, not hashes: two texts end
with the same number of blocks and the same name if and only if they are equal. A text of n blocks takes part in about log2(n)
rounds, and each round has half the rows of the one before.

A block which a third of all rows hold is spread over as many range partitions as it fills (see ``runs``). Names are made in one
streaming pass over each sorted partition; values whose runs go on in other partitions are settled from a few rows a partition.
Every round is written to the shared folder: a lost executor costs a reread of the round before.

Edges: a null text is an empty one, and equals texts of white space only; texts are equal by their bytes, however long they are
(a text is held by one task while it is cut, after that its blocks are rows of their own); rows without a key or with the same
key are rows of their own, of which the equal ones form groups like others (a row without a key stays only if no other of its
size has one; of rows that tie in everything one stays); an empty table gives an empty result; other columns pass through
``deduplicated`` whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from papyra.llm.runs import Edges, begins
from papyra.llm.shared import WORD, release, row_of, small_batches, table, written

#: Bytes of a block.
BLOCK = 1024
#: Bytes of blocks that a task holds before it passes them on.
HELD = 4 << 20
SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
_BLOCK = (("r", pa.int64()), ("i", pa.int64()), ("n", pa.int64()), ("b", pa.binary()), ("c", pa.int64()), ("h", pa.string()))
_BLOCK_SQL = "r long, i long, n long, b binary, c long, h string"


def cut(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """(r, i, n, b, c, h, k) from (r, k, text): block ``b`` at place ``i`` of the ``n`` of row ``r``; on the first block also the
    code points of the text as it was, the SHA-256 of what is left of it, and the row's key. An empty text has one empty block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            schema = pa.schema([*_BLOCK, ("k", batch.column(1).type)])
            rows = lambda out: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
            out: list[tuple] = []
            held = 0
            for r, k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                text = text.as_py() or ""
                rest = text.encode().translate(None, SPACE)
                n = max(-(-len(rest) // block), 1)
                out.append((r, 0, n, rest[:block], len(text), hashlib.sha256(rest).hexdigest(), k))
                held += block
                for i in range(1, n):
                    out.append((r, i, n, rest[i * block : (i + 1) * block], None, None, None))
                    held += block
                    if held >= HELD:
                        yield rows(out)
                        out, held = [], 0
            if out:
                yield rows(out)

    small_batches(rows.sparkSession)
    return rows.mapInArrow(run, f"{_BLOCK_SQL}, k {rows.schema[1].dataType.simpleString()}")


def _runs(columns: int):
    """A pass over a sorted partition (h, values, r, i, n): each row's run, counted from 0; and at the end the runs at the
    partition's edges (r null) with their values, and one row (run null) with the number of runs in n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, last, edges = TaskContext.get().partitionId(), -1, None, Edges()
        names, types = ["p", "run", "r", "i", "n", "h", *(f"v{j}" for j in range(columns))], []
        for batch in batches:
            m = batch.num_rows
            if not m:
                continue
            keys = [batch.column(j) for j in range(columns + 1)]
            types = [k.type for k in keys]
            new = begins(keys, last)
            runs = at + np.cumsum(new)
            edges.add(keys[0].to_numpy(), np.flatnonzero(new), lambda j: (int(runs[j]), *(k[j].as_py() for k in keys)))  # noqa: B023  called at once
            at, last = int(runs[-1]), [k[m - 1].as_py() for k in keys]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(m, part, dtype=np.int32)), pa.array(runs, pa.int64()), *(batch.column(columns + j) for j in (1, 2, 3)), *(pa.nulls(m, t) for t in types)], names)
        if types:
            told = list(zip(*edges.told()))
            m = len(told[0])
            none = [pa.nulls(m, pa.int64())] * 3
            yield pa.RecordBatch.from_arrays([pa.array([part] * m, pa.int32()), pa.array(told[0], pa.int64()), *none, *(pa.array(v, t) for v, t in zip(told[1:], types))], names)
            none = [pa.nulls(1, pa.int64())] * 3
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), *none, pa.array([at + 1], pa.int64()), *(pa.nulls(1, t) for t in types)], names)

    return run


def named(rows: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(r, i, n, name) from rows (*keys, r, i, n): names are whole numbers, equal for equal values of the keys and for no others;
    and the written table behind it, to release. A name is the place of its run among all runs, in the order of the partitions;
    a value whose runs are in several has the name of the first. Only one row a partition is ordered in one task."""
    types = dict(rows.dtypes)
    values = [f"v{j}" for j in range(len(keys))]
    dealt = rows.select(F.xxhash64(*keys).alias("h"), *keys, "r", "i", "n").repartitionByRange("h", "r", "i").sortWithinPartitions("h", *keys, "r", "i")
    done = written(dealt.mapInArrow(_runs(len(keys)), ", ".join(["p int, run long, r long, i long, n long, h long", *(f"{v} {types[k]}" for v, k in zip(values, keys))])), "names")
    before = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    starts = done.filter("run is null").select("p", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    edges = done.filter("run is not null and r is null").join(F.broadcast(starts), "p").withColumn("name", F.col("start") + F.col("run"))
    shared = edges.select("p", "run", "name", F.min("name").over(Window.partitionBy("h", *values)).alias("first")).filter("first < name").select("p", "run", "first")
    out = done.filter("r is not null").select("p", "run", "r", "i", "n").join(F.broadcast(starts), "p").join(F.broadcast(shared), ["p", "run"], "left")
    return out.select("r", "i", "n", F.coalesce("first", F.col("start") + F.col("run")).alias("name")), done


def identities(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """(r, k, blocks, name, c, h), written, from (r, k, text) with r a number of its own for each row: (blocks, name) is equal for
    equal texts and for no others; c is the text's code points, h the SHA-256 of what was compared."""
    blocks = written(cut(rows, block), "blocks")
    meta = blocks.filter("i = 0").select("r", "k", F.col("n").alias("blocks"), "c", "h")
    level, behind = named(blocks, ["b"])
    found, tables, most = [], [behind], blocks.agg(F.max("n")).first()[0] or 1
    while True:
        found.append(level.filter("n = 1").select("r", "name"))
        if most == 1:
            break
        at = lambda odd: F.max(F.when(F.col("i") % 2 == odd, F.col("name")))
        pairs = level.filter("n > 1").groupBy("r", F.shiftright("i", 1).alias("i")).agg(at(0).alias("a"), F.coalesce(at(1), F.lit(-1)).alias("b"), F.max("n").alias("n"))
        level, behind = named(pairs.withColumn("n", F.shiftright(F.col("n") + 1, 1)), ["a", "b"])
        tables.append(behind)
        most = (most + 1) // 2
    names = found[0]
    for f in found[1:]:
        names = names.unionByName(f)
    out = written(names.join(meta, "r"), "identities")
    release(blocks, *tables)
    return out


def classes(docs: DataFrame, *, text: str = "text", key: str = "doc_id", block: int = BLOCK) -> DataFrame:
    """One row for each of ``docs``, which are rows (r, key, text): r, key, keep (the key of the row that stays), keep_r,
    group_size, kept, sha256. Of equal texts that with the most code points stays, then that with the least key."""
    rows = identities(docs.select("r", F.col(key).alias("k"), F.col(text).alias("text")), block)
    best = F.min(F.struct((-F.col("c")).alias("c"), F.col("k").isNull().alias("none"), "k", "r"))
    groups = written(rows.groupBy("blocks", "name").agg(F.count("*").alias("group_size"), best.alias("best")), "identity-groups")
    out = rows.join(groups, ["blocks", "name"])
    return out.select("r", "k", F.col("best.k").alias("keep"), F.col("best.r").alias("keep_r"), "group_size", (F.col("best.r") == F.col("r")).alias("kept"), F.col("h").alias("sha256"))


def deduplicated(docs: DataFrame, *, text: str = "text", key: str = "doc_id", block: int = BLOCK) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns."""
    rows = written(docs.select(row_of(docs).alias("row"), F.monotonically_increasing_id().alias("r")), "rows")
    by = rows.select("r", F.col(f"row.`{key}`").alias("k"), F.col(f"row.`{text}`").alias("t"))
    stay = classes(by, text="t", key="k", block=block).filter("kept").select("r")
    return rows.join(stay, "r", "left_semi").select("row.*")


def op13_block_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.monotonically_increasing_id().alias("r"))
    return classes(docs).select(F.col("k").alias("doc_id"), F.col("keep").alias("keep_id"), "group_size", "kept", F.col("sha256").alias("text_sha256"))


OP13_SQL = rf"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS c, array_to_string(regexp_extract_all(coalesce(text, ''), '{WORD}'), '') AS rest FROM documents),
w AS (SELECT *, row_number() OVER g AS i, first_value(doc_id) OVER g AS keep_id, count(*) OVER (PARTITION BY rest) AS group_size
      FROM d WINDOW g AS (PARTITION BY rest ORDER BY c DESC, doc_id NULLS LAST))
SELECT doc_id, keep_id, group_size, i = 1 AS kept, sha256(rest) AS text_sha256 FROM w"""
