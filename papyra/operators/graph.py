"""Entities and their relations as a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from papyra.operators.temporal import valid_at


def one_hop(edges: DataFrame, center: object, n: int, most: int = 100) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) around a node at chapter n. Edges come in their order (start, source, target, kind) as long as fewer
    than ``most`` nodes, the centre included, and fewer than ``most`` edges stand before."""
    order = ["start_chapter", "source", "target", "kind"]
    near = edges.filter(((F.col("source") == center) | (F.col("target") == center)) & valid_at(n)).orderBy(*order).limit(most)
    # What is left are ``most`` rows.
    place = Window.orderBy(*order)
    near = near.withColumn("__other", F.when(F.col("source") == center, F.col("target")).otherwise(F.col("source"))).withColumn("__r", F.row_number().over(place))
    fresh = (F.col("__other") != center) & (F.row_number().over(Window.partitionBy("__other").orderBy("__r")) == 1)
    seen = 1 + F.coalesce(F.sum(F.col("__fresh").cast("int")).over(place.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    near = near.withColumn("__fresh", fresh).withColumn("__seen", seen).filter(F.col("__seen") < most).select(*edges.columns)
    nodes = near.select(F.col("source").alias("node")).unionByName(near.select(F.col("target").alias("node"))).distinct()
    return nodes, near


def root_of(nodes: DataFrame, center: object) -> DataFrame:
    """(node): the centre if it is among the nodes or there are none, else their least."""
    n = nodes.agg(F.count("*").alias("n"), F.coalesce(F.bool_or(F.col("node") == center), F.lit(False)).alias("there"), F.min("node").alias("least"))
    return n.select(F.when(F.col("there") | (F.col("n") == 0), F.lit(center)).otherwise(F.col("least")).alias("node"))


def layer(nodes: DataFrame, edges: DataFrame, keep) -> tuple[DataFrame, DataFrame]:
    """Nodes of a layer, and the edges with both ends in it."""
    kept = nodes.filter(keep)
    ids = kept.select("node")
    inside = edges.join(ids.withColumnRenamed("node", "source"), "source", "left_semi").join(ids.withColumnRenamed("node", "target"), "target", "left_semi")
    return kept, inside


def alias_groups(records: DataFrame, checkpoint, most: int = 50) -> DataFrame:
    """(record, root): records that share a name, directly or by others, have the least record among them as root.
    records: (record, name); checkpoint: cuts the lineage of a frame, once a round."""
    names = checkpoint(records.filter("name <> ''").select("record", "name").distinct())
    labels = checkpoint(names.select("record").distinct().withColumn("root", F.col("record")))
    for _ in range(most):
        by_name = names.join(labels, "record").groupBy("name").agg(F.min("root").alias("root"))
        near = names.join(by_name, "name").groupBy("record").agg(F.min("root").alias("near"))
        step = labels.join(near, "record").select("record", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        jump = step.select(F.col("record").alias("root"), F.col("root").alias("far"))
        labels = checkpoint(step.join(jump, "root").select("record", F.col("far").alias("root"), (F.col("far") != F.col("old")).alias("moved")))
        if labels.filter("moved").isEmpty():
            return labels.select("record", "root")
    raise RuntimeError("aliases didn't settle")
