"""Narrative tables made of the test tables: states of entities by chapter, and relations observed in chapters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: entity: user; chapter: day; status: the day's last event; value: its value.
SNAPSHOTS = """snap AS (
  SELECT entity, chapter, status, value FROM (
    SELECT user_id AS entity, date_diff('day', DATE '2024-01-01', ts::DATE) AS chapter, event_type AS status, value,
           row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1)"""
#: source: customer; target: supplier; kind: return flag; chapter: month of shipping.
EDGES = """edge AS (
  SELECT o_custkey AS source, l_suppkey AS target, l_returnflag AS kind, (year(l_shipdate) * 12 + month(l_shipdate))::BIGINT AS chapter,
         sum(l_quantity) AS weight
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL)"""


def snapshots(t) -> DataFrame:
    e = t("events").withColumn("chapter", F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).cast("long"))
    last = F.struct("ts", "event_id")
    return e.groupBy(F.col("user_id").alias("entity"), "chapter").agg(F.max_by("event_type", last).alias("status"), F.max_by("value", last).alias("value"))


def observations(t) -> DataFrame:
    """A row for each line, from which edges are added up."""
    both = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    chapter = (F.year("l_shipdate") * 12 + F.month("l_shipdate")).cast("long")
    return both.select(F.col("o_custkey").alias("source"), F.col("l_suppkey").alias("target"), F.col("l_returnflag").alias("kind"), chapter.alias("chapter"), "l_quantity")


def edges(t) -> DataFrame:
    return observations(t).groupBy("source", "target", "kind", "chapter").agg(F.sum("l_quantity").alias("weight"))
