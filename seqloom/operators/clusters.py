"""Clusters of targets that share reads: least label along the links of shared members, with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.workspace import Workspace


def shared_members(df: DataFrame, group: str, node: str, max_rounds: int = 64) -> DataFrame:
    """(node, cluster): nodes that share a group, directly or through others, have the same cluster, its least node.

    A group links each of its nodes to the least of them, so links are at most members and mostly far fewer, as many groups give the same
    ones; groups of one node give none. Each round gives every linked node the least label of its neighbours, a map-side combined
    aggregation, and then lets a label point to the label of its own node.
    """
    ws = Workspace(df.sparkSession, "clusters")
    m = ws.write(df.select(F.col(group).alias("g"), F.col(node).alias("node")).where("g is not null and node is not null").distinct(), "members")
    least = m.groupBy("g").agg(F.min("node").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1").select("g", "least")
    links = ws.write(m.join(least, "g").where("node <> least").select("node", "least").distinct(), "links")
    links = ws.write(links.select("node", F.col("least").alias("other")).unionByName(links.select(F.col("least").alias("node"), F.col("node").alias("other"))), "both")
    now = ws.write(links.select("node").distinct().withColumn("cluster", F.col("node")), "labels-0")
    for i in range(1, max_rounds + 1):
        near = links.join(now.withColumnRenamed("node", "other"), "other").select("node", "cluster")
        new = ws.write(near.unionByName(now).groupBy("node").agg(F.min("cluster").alias("cluster")), f"step-{i}")
        jumped = new.join(new.select(F.col("node").alias("cluster"), F.col("cluster").alias("further")), "cluster", "left")
        nxt = ws.write(jumped.select("node", F.least("cluster", F.coalesce("further", "cluster")).alias("cluster")), f"labels-{i}")
        done = nxt.join(now.withColumnRenamed("cluster", "before"), "node").where("cluster <> before").isEmpty()
        ws.drop(f"step-{i}")
        if done:
            return m.select("node").distinct().join(nxt, "node", "left").select("node", F.coalesce("cluster", "node").alias("cluster"))
        ws.drop(f"labels-{i - 1}")
        now = nxt
    raise RuntimeError(f"no end after {max_rounds} rounds")
