"""Consolidating pairwise matches into groups: alternating large-star and small-star steps.

Each step rewrites the table of edges (node, lesser node): large-star ties the greater neighbours of every node
to the least of its neighbourhood, small-star ties its lesser neighbours and itself to the least of them.  When a
pair of steps changes nothing, every node is tied to the least node of its component.  Each step is two
aggregations or joins over the edges; no neighbourhood is ever collected.  A node with a very large neighbourhood
(the centre of a star) is joined by broadcast; there are at most 1 / hot_share of those.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.workspace import Workspace


def star_edges(df: DataFrame, group: str, node: str, ws: Workspace, name: str, hot_share: float = 0.001) -> DataFrame:
    """Edges (u, v), u > v, that connect all nodes of a group, for every group, without pairs within groups.

    Every node is tied to the least node of its group.  The least nodes come from a map-side combined
    aggregation; groups with at least ``hot_share`` of the distinct rows are joined to theirs by broadcast.
    Null groups and null nodes are no members.
    """
    members = df.where(F.col(group).isNotNull() & F.col(node).isNotNull()).select(F.col(group).alias("g"), F.col(node).cast("long").alias("u"))
    members = ws.write(members.distinct(), f"{name}-members")
    least = ws.write(members.groupBy("g").agg(F.min("u").alias("v"), F.count(F.lit(1)).alias("n")).where("n > 1"), f"{name}-least")
    edges = _tie(members, least, "g", hot_share).where("u > v").select("u", "v").distinct()
    out = ws.write(edges, f"{name}-edges")
    ws.drop(f"{name}-members")
    ws.drop(f"{name}-least")
    return out


def _tie(rows: DataFrame, least: DataFrame, key: str, hot_share: float) -> DataFrame:
    """rows with the ``v`` of their key; ``least`` has one row a key, with n, the number of its rows."""
    total = least.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    limit = max(2, int(hot_share * total))
    hot = least.where(F.col("n") >= limit).select(key, "v")
    if total <= 100_000 or hot.isEmpty():
        return rows.join(least.select(key, "v"), key)
    hot = F.broadcast(hot)  # at most 1 / hot_share rows
    cold = rows.join(hot.select(key), key, "left_anti").join(least.where(F.col("n") < limit).select(key, "v"), key)
    return rows.join(hot, key).unionByName(cold)


def connected_components(edges: DataFrame, u: str, v: str, max_rounds: int = 64, hot_share: float = 0.001) -> DataFrame:
    """(node, component): the least node of its component, for every node of an edge to another node.

    Edges are undirected; loops, repeated edges and edges with a null end are ignored, so a node without an edge
    to another node is in no group. Node ids are longs. An empty table gives no rows.
    """
    ws = Workspace(edges.sparkSession, "components")
    a, b = F.col(u).cast("long"), F.col(v).cast("long")
    now = edges.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    now = ws.write(now, "round-0")
    state = _fingerprint(now)
    for i in range(1, max_rounds + 1):
        # large star: for u with neighbourhood N, m = min(N, u): (x, m) for each x of N above u
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = ws.write(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n")), f"least-{i}")
        up = now.select(F.col("v").alias("k"), F.col("u").alias("x"))  # x above k
        large = _tie(up, least.select(F.col("u").alias("k"), F.col("m").alias("v"), "n"), "k", hot_share).where("x > v").select(F.col("x").alias("u"), "v").distinct()
        large = ws.write(large, f"large-{i}")
        # small star: for u with lesser neighbours N, m = min(N): (x, m) for each x of N other than m, and (u, m)
        down = ws.write(large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), f"down-{i}")
        tied = _tie(large.select(F.col("u").alias("k"), F.col("v").alias("x")), down.select(F.col("u").alias("k"), F.col("m").alias("v"), "n"), "k", hot_share)
        small = tied.where("x > v").select(F.col("x").alias("u"), "v").unionByName(down.select("u", F.col("m").alias("v"))).distinct()
        now = ws.write(small, f"round-{i}")
        for n in (f"least-{i}", f"large-{i}", f"down-{i}", f"round-{i - 1}"):
            ws.drop(n)
        before, state = state, _fingerprint(now)
        if before == state:
            roots = now.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
    raise RuntimeError(f"no end after {max_rounds} rounds")


def _fingerprint(edges: DataFrame) -> tuple:
    """Number of edges and an order-free sum of their hashes (as decimal, so that it cannot overflow)."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
