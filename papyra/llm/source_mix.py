"""Mixing sources to target weights by systematic sampling, in DataFrame functions only.

Each source gets a share of all words by weight, at most ``cap`` times its own words; what a capped source can't take is
shared again by weight. Within a source the documents stand in a fixed order, each expects ``rate = target / source size``
copies, the expected copies are prefix-summed, one random offset per source is added, and a document is emitted once for
each integer that its interval crosses. The order goes by size first, so the words taken differ from the target by about
the largest document's size.

Prefix sums are two-level, so that a source with a third of all rows is never in one task: rows are numbered inside small
cells (source, size class, salt), and the cells' counts are prefix-summed apart; a source has at most ``salts`` cells in
each of some 400 size classes.

Edges: a null or empty text has size 0, expects copies like the others and takes 0 words; a source with no words has rate
0; a null source is a source of its own and ranks last; rows with a null key or the same key count one by one; extra
columns pass through; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from papyra.llm.shared import WORD, row_of, table

WEIGHTS, CAP, SEED, SALTS = (5, 2, 1), 3, "mix-1", 64


def _hash32(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def _sized(docs: DataFrame, text: str, source: str, key: str, seed: str, salts: int) -> DataFrame:
    size = F.coalesce(F.regexp_count(docs[text], F.lit(WORD)), F.lit(0)).cast("long")
    d = docs.select(
        row_of(docs).alias("row"), docs[key].alias("k"), docs[text].alias("t"), F.coalesce(docs[source], F.lit("")).alias("sk"),
        docs[source].isNull().cast("int").alias("sn"), size.alias("size"),
    )
    # The class of a size: its bit length and its next three bits; it grows with the size.
    bits = F.length(F.bin("size"))
    d = d.withColumn("cell", (bits * 8 + F.expr("shiftright(size, greatest(length(bin(size)) - 4, 0)) & 7")).cast("int"))
    return d.withColumn("salt", (_hash32(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("k").cast("string"), F.col("t"), F.lit("")))) % salts).cast("int"))


def _sources(cells: DataFrame, weights: tuple[int, ...], cap: int, seed: str) -> DataFrame:
    """One row per source: its target. Filled up like vessels: all sources rise by weight, those at their cap stay there."""
    s = cells.groupBy("sk", "sn").agg(F.sum("n").alias("docs"), F.sum("w").alias("source_size"))
    by_name, every = Window.orderBy("sn", "sk"), Window.partitionBy(F.lit(1))
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")).cast("long"))
    s = s.withColumn("cap", F.col("source_size") * cap).withColumn("total", F.sum("source_size").over(every))
    fill = Window.orderBy(F.col("cap") / F.col("weight"), "sn", "sk")
    s = s.withColumn("below", F.coalesce(F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    s = s.withColumn("open", F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing)))
    # The first source, in this order, that doesn't reach its cap sets the level for itself and all later ones.
    s = s.withColumn("stops", F.col("cap") * F.col("open") >= (F.col("total") - F.col("below")) * F.col("weight"))
    s = s.withColumn("at", F.row_number().over(fill)).withColumn("lvl", F.when(F.col("stops"), F.struct("at", "below", "open")))
    s = s.withColumn("lvl", F.min("lvl").over(every))
    raised = (F.col("weight") * (F.col("total") - F.col("lvl.below"))).cast("double") / F.col("lvl.open")
    s = s.withColumn("target", F.when(F.col("at") < F.col("lvl.at"), F.col("cap").cast("double")).otherwise(raised))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    offset = _hash32(F.concat(F.lit(f"{seed}|offset|"), F.col("sn").cast("string"), F.lit("|"), F.col("sk"))) / F.lit(4294967296.0)
    return s.select("sk", "sn", "source_size", "target", rate.alias("rate"), offset.alias("offset"))


def systematic_copies(docs: DataFrame, *, text: str = "text", source: str = "source", key: str = "doc_id", weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: str = SEED, salts: int = SALTS) -> DataFrame:
    """Every row of ``docs`` (in struct ``row``) with size, source_size, target and copies (0 to ``cap``)."""
    d = _sized(docs, text, source, key, seed, salts)
    cells = d.groupBy("sk", "sn", "cell", "salt").agg(F.count("*").alias("n"), F.sum("size").alias("w"))
    before = lambda w: F.coalesce(w, F.lit(0))
    prior = (Window.unboundedPreceding, -1)
    by_cell = cells.groupBy("sk", "sn", "cell").agg(F.sum("n").alias("m"))
    by_cell = by_cell.withColumn("cells_before", before(F.sum("m").over(Window.partitionBy("sk", "sn").orderBy("cell").rowsBetween(*prior)))).drop("m")
    starts = cells.withColumn("salts_before", before(F.sum("n").over(Window.partitionBy("sk", "sn", "cell").orderBy("salt").rowsBetween(*prior))))
    starts = starts.join(by_cell, ["sk", "sn", "cell"]).join(_sources(cells, weights, cap, seed), ["sk", "sn"])
    starts = starts.select("sk", "sn", "cell", "salt", (F.col("cells_before") + F.col("salts_before")).alias("before"), "source_size", "target", "rate", "offset")
    inside = Window.partitionBy("sk", "sn", "cell", "salt").orderBy("size", F.col("k").asc_nulls_first(), F.xxhash64("t"))
    d = d.withColumn("i", F.row_number().over(inside)).join(starts, ["sk", "sn", "cell", "salt"])
    crossed = lambda i: F.floor(i * F.col("rate") + F.col("offset"))
    at = (F.col("before") + F.col("i")).cast("double")
    copies = F.least(crossed(at) - crossed(at - 1.0), F.lit(cap)).cast("int")
    return d.select("row", "size", "source_size", "target", copies.alias("copies"))


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: the columns of ``docs``, a row for each copy taken."""
    taken = systematic_copies(docs, **how).filter("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("row.*")


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    d = systematic_copies(docs)
    return d.select(F.col("row.doc_id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"))


OP5_SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS sk, (source IS NULL)::INT AS sn,
         coalesce(length(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size,
         ('0x' || substr(md5('{SEED}|' || coalesce(doc_id::VARCHAR, text, '')), 1, 8))::BIGINT % {SALTS} AS salt
  FROM documents),
e AS (SELECT *, length(bin(size)) * 8 + ((size >> greatest(length(bin(size)) - 4, 0)) & 7) AS cell FROM d),
s AS (SELECT sk, sn, sum(size)::BIGINT AS source_size FROM e GROUP BY ALL),
w AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY sn, sk) - 1) % 3 + 1)::INT] AS weight, source_size * {CAP} AS cap,
             sum(source_size) OVER ()::BIGINT AS total FROM s),
f AS (SELECT *, row_number() OVER fill AS pos,
             coalesce(sum(cap) OVER (fill ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS below,
             sum(weight) OVER (fill ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS rest
      FROM w WINDOW fill AS (ORDER BY cap::DOUBLE / weight, sn, sk)),
l AS (SELECT pos, below, rest FROM f WHERE cap * rest >= (total - below) * weight ORDER BY pos LIMIT 1),
t AS (SELECT f.sk, f.sn, f.source_size,
             CASE WHEN f.pos < l.pos THEN f.cap::DOUBLE ELSE (f.weight * (f.total - l.below))::DOUBLE / l.rest END AS target,
             ('0x' || substr(md5('{SEED}|offset|' || f.sn || '|' || f.sk), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
      FROM f, l),
r AS (SELECT e.doc_id, e.size, t.source_size, t.target, t.u, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
             row_number() OVER (PARTITION BY e.sn, e.sk ORDER BY e.cell, e.salt, e.size, e.doc_id NULLS FIRST)::DOUBLE AS i
      FROM e JOIN t ON e.sk = t.sk AND e.sn = t.sn)
SELECT doc_id, size, source_size, target,
       (size * least(floor(i * rate + u) - floor((i - 1) * rate + u), {CAP}))::BIGINT AS taken
FROM r"""
