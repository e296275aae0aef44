"""Connected components of an edge table, by least labels with hooking of roots and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import looked_up, written


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over the edges (a, b). Nodes without edges aren't in it.

    Each round takes the least label among neighbours, for the node and for the node that is its label, with partial
    minima before the shuffle, and then the label of that label; it ends when no label changes. Labels only fall, so
    it always ends; chains take rounds by the logarithm of their length. Each round is written to the shared folder.
    Nodes with very many edges and components of very many nodes are looked up by a bounded broadcast, so a star or a
    giant component isn't one task's.
    """
    both = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b")
    both = written(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    n_edges = both.count()
    begin = both.groupBy("a").agg(F.min("b").alias("low"), F.count("*").alias("degree"))
    labels = written(begin.select(F.col("a").alias("node"), F.least("a", "low").alias("component"), "degree"), "labels")
    n_nodes = labels.count()
    while True:
        near = looked_up(both, labels.withColumnRenamed("node", "b"), "b", n_edges, "degree").groupBy("a").agg(F.min("component").alias("low"))
        met = labels.join(near.select(F.col("a").alias("node"), "low"), "node").select("node", F.col("component").alias("old"), "low", "degree")
        hooks = met.groupBy("old").agg(F.min("low").alias("hook")).withColumnRenamed("old", "root")
        step = met.join(hooks, F.col("node") == F.col("root"), "left").select("node", "old", F.least("old", "low", "hook").alias("component"), "degree")
        step = written(step, "step")
        members = step.groupBy("component").agg(F.count("*").alias("members"))
        beyond = members.join(step.select(F.col("node").alias("component"), F.col("component").alias("beyond")), "component")
        jumped = looked_up(step, beyond, "component", n_nodes, "members")
        labels = written(jumped.select("node", "old", F.least("component", F.coalesce("beyond", "component")).alias("component"), "degree"), "labels")
        settled = labels.where("old <> component").isEmpty()
        labels = labels.drop("old")
        if settled:
            return labels.drop("degree")
