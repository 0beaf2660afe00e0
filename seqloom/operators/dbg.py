"""De Bruijn graph over canonical k-mers: edges, degrees, and maximal non-branching paths (unitigs).

Every node has two ends, R (its right) and L (its left). Leaving a node by an end spells k - 1 bases, ``out``: the
suffix for R, the reverse complement of the prefix for L. Two ends are joined if the ``out`` of one is the reverse
complement of that of the other. Both then lie at the same junction, the canonical form of ``out``, on opposite
sides. At most eight ends meet at a junction, so all edges, degrees and mergeable pairs come from one aggregation by
junction, without a self-join. A junction that is its own reverse complement joins all its ends, also with themselves.

Nodes are packed k-mers, k of at most 31.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.packing import reverse_packed, reverse_values
from ..plans.workspace import Workspace


def ends(kmers: DataFrame, kmer: str, k: int) -> DataFrame:
    """(node, end, junction, side): two rows a node; side is 1 where out is the junction, -1 where it is its reverse
    complement, 0 where both are the same."""

    def run(batches):
        for b in batches:
            v = b.column(0).to_numpy()
            suffix, prefix = v & ((1 << (2 * (k - 1))) - 1), v >> 2
            for end, out, back in (("R", suffix, reverse_values(suffix, k - 1)), ("L", reverse_values(prefix, k - 1), prefix)):
                cols = [b.column(0), pa.array([end]).take(pa.array(np.zeros(len(v), np.int64))), pa.array(np.minimum(out, back)), pa.array(np.sign(back - out).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(cols, ["node", "end", "junction", "side"])

    return kmers.where(F.col(kmer).isNotNull()).select(F.col(kmer).cast("long")).mapInArrow(run, "node long, end string, junction long, side int")


def junctions(kmers: DataFrame, kmer: str, k: int) -> DataFrame:
    """(junction, ends): at most eight (side, node, end) each."""
    return ends(kmers, kmer, k).groupBy("junction").agg(F.collect_list(F.struct("side", "node", "end")).alias("ends"))


def edges(kmers: DataFrame, kmer: str, k: int) -> DataFrame:
    """(src, src_end, dst, dst_end), both directions of every edge; an end joined with itself has one row."""
    j = junctions(kmers, kmer, k).select(F.explode("ends").alias("a"), "ends")
    j = j.select("a", F.explode(F.filter("ends", lambda b: b["side"] == -F.col("a.side"))).alias("b"))
    return j.select(F.col("a.node").alias("src"), F.col("a.end").alias("src_end"), F.col("b.node").alias("dst"), F.col("b.end").alias("dst_end"))


def degrees(kmers: DataFrame, kmer: str, k: int) -> DataFrame:
    """(node, deg_l, deg_r)."""
    j = junctions(kmers, kmer, k).select(F.explode("ends").alias("a"), "ends")
    d = j.select("a.node", "a.end", F.size(F.filter("ends", lambda b: b["side"] == -F.col("a.side"))).alias("n"))
    return d.groupBy("node").agg(F.sum(F.when(F.col("end") == "L", F.col("n"))).alias("deg_l"), F.sum(F.when(F.col("end") == "R", F.col("n"))).alias("deg_r"))


def mergeable(kmers: DataFrame, kmer: str, k: int) -> DataFrame:
    """(a, a_end, b, b_end): junctions with exactly one end on either side, of different nodes; a's side is 1."""
    j = junctions(kmers, kmer, k)
    one = lambda s: F.filter("ends", lambda x: x["side"] == s)
    j = j.where(F.size("ends") == 2).select(one(1).alias("p"), one(-1).alias("m")).where((F.size("p") == 1) & (F.size("m") == 1))
    j = j.select(F.col("p")[0].alias("p"), F.col("m")[0].alias("m")).where(F.col("p.node") != F.col("m.node"))
    return j.select(F.col("p.node").alias("a"), F.col("p.end").alias("a_end"), F.col("m.node").alias("b"), F.col("m.end").alias("b_end"))


def _oriented(node: Column, forward: Column) -> Column:
    """Number of an oriented node: even forward, odd backward."""
    return F.shiftleft(node, 1).bitwiseOR(F.when(forward, F.lit(0)).otherwise(F.lit(1)).cast("long"))


def neighbourhoods(values: np.ndarray, k: int, m: int) -> np.ndarray:
    """A number that k-mers next to each other mostly share: the least of the mixed canonical m-mers of a canonical k-mer."""
    best = np.full(len(values), np.iinfo(np.int64).max)
    for j in range(k - m + 1):
        w = (values >> (2 * j)) & ((1 << (2 * m)) - 1)
        mixed = np.minimum(w, reverse_values(w, m)) * np.int64(0x2545F4914F6CDD1D) & np.iinfo(np.int64).max
        np.minimum(best, mixed, out=best)
    return best


def _walk(v: np.ndarray, head: np.ndarray, dist: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(head, dist, low, cyclic) of steps from v to head among themselves: the first head that no step here leaves, the distance to
    it and the least number on the way; on a cycle, the least number of the cycle."""
    head, dist, low = head.copy(), dist.copy(), low.copy()
    order = np.argsort(v)
    at = np.minimum(np.searchsorted(v[order], head), len(v) - 1)
    nxt = np.where(v[order][at] == head, order[at], -1)
    for _ in range(len(v).bit_length() + 1):
        on = np.flatnonzero(nxt >= 0)
        if not len(on):
            break
        j = nxt[on]
        h, d, w, n = head[j], dist[on] + dist[j], np.minimum(low[on], low[j]), nxt[j]
        head[on], dist[on], low[on], nxt[on] = h, d, w, n
    return head, dist, low, nxt >= 0


_STEPS = "v long, head long, dist long, low long, cyclic boolean"


def _walk_batches(rows: int | None):
    """Walk along the steps (v, head, dist, low) of a partition, in pieces of ``rows`` or all together."""

    def run(batches):
        held, size = [], 0
        for b in itertools.chain(batches, [None]):
            if b is not None:
                held.append(b)
                size += b.num_rows
            if held and (b is None or rows is not None and size >= rows):
                t = pa.Table.from_batches(held)
                cols = [t[c].combine_chunks().to_numpy() for c in ("v", "head", "dist", "low")]
                held, size = [], 0
                if len(cols[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (cols[0], *_walk(*cols))], ["v", "head", "dist", "low", "cyclic"])

    return run


def _shortened(ws: Workspace, links: DataFrame, name: str, k: int, rows: int = 1_000_000) -> DataFrame:
    """Links (v, pred) as (v, head, dist, low, cyclic), gone along as far as they lie together. Links are put beside their
    neighbours by :func:`neighbourhoods` and taken in pieces of ``rows``; where a piece ends, so does the walk, whatever lies beyond."""
    m = max(1, min(9, k - 1))

    def place(batches):
        for b in batches:
            v = b.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(neighbourhoods(v >> 1, k, m))], ["v", "head", "place"])

    placed = links.select("v", "pred").mapInArrow(place, "v long, head long, place long").repartition("place").sortWithinPartitions("place")
    steps = placed.select("v", "head", F.lit(1).cast("long").alias("dist"), F.least("v", "head").alias("low"))
    return ws.write(steps.mapInArrow(_walk_batches(rows), _STEPS), name)


def _jump(ws: Workspace, links: DataFrame, name: str, k: int, rounds: int, most_steps: int = 2_000_000) -> DataFrame:
    """Paths of (v, pred): (v, head, dist, low, closed). ``closed`` rows have reached a head without a predecessor; the others lie
    on cycles and ``low`` is the least number passed, that of the whole cycle in the end.

    Most of each path is gone along in place, see _shortened. Only steps that others end at, a fraction of all, go on: up to
    ``most_steps`` of them (some 100 MB) in one task, as that takes less than a round of joins, more by pointer doubling. One join then
    carries their heads back to all rows.
    """
    short = _shortened(ws, links, f"{name}-short", k)
    asked = short.where("not cyclic").select(F.col("head").alias("v")).distinct()
    open_ = ws.write(short.join(asked, "v", "left_semi").where("not cyclic").drop("cyclic"), f"{name}-open")
    if open_.count() <= most_steps:
        ends = ws.write(open_.coalesce(1).mapInArrow(_walk_batches(None), _STEPS), f"{name}-ends")
        ends = ends.select("v", "head", "dist", "low", (~F.col("cyclic")).alias("closed"))
    else:
        ends = _double(ws, open_, name, rounds)
    ends = ends.select(F.col("v").alias("head"), F.col("head").alias("h2"), F.col("dist").alias("d2"), F.col("low").alias("l2"), F.col("closed").alias("c2"))
    whole = short.where("not cyclic").join(ends, "head", "left").select(
        "v", F.coalesce("h2", "head").alias("head"), (F.col("dist") + F.coalesce("d2", F.lit(0))).alias("dist"), F.least("low", "l2").alias("low"), F.coalesce("c2", F.lit(True)).alias("closed")
    )
    return whole.unionByName(short.where("cyclic").select("v", "head", "dist", "low", F.lit(False).alias("closed")))


def _double(ws: Workspace, open_: DataFrame, name: str, rounds: int) -> DataFrame:
    """Pointer doubling over the steps (v, head, dist, low): (v, head, dist, low, closed). Only rows that are not closed yet are looked
    up and rewritten in a round."""
    closed, n = None, open_.count()
    for i in range(rounds):
        if not n:
            break
        nxt = open_.select(F.col("v").alias("head"), F.col("head").alias("h2"), F.col("dist").alias("d2"), F.col("low").alias("l2"), F.lit(False).alias("end"))
        if closed is not None:
            nxt = nxt.unionByName(closed.select(F.col("v").alias("head"), F.col("head").alias("h2"), F.col("dist").alias("d2"), F.col("low").alias("l2"), F.lit(True).alias("end")))
        j = open_.join(nxt, "head", "left")
        # no row for the head: it has no predecessor, so it is the start of the path
        j = j.select("v", F.coalesce("h2", "head").alias("head"), (F.col("dist") + F.coalesce("d2", F.lit(0))).alias("dist"), F.least("low", "l2").alias("low"), (F.col("h2").isNull() | F.col("end")).alias("closed"))
        # closed rows lie in a folder of their own, so later rounds read only what they need
        step = ws.write(j, f"{name}-step-{i}", ["closed"])
        now = step.where("closed").drop("closed")
        closed = now if closed is None else closed.unionByName(now)
        open_ = step.where("not closed").drop("closed")
        before, n = n, open_.count()
        if n == before and i + 1 >= max(1, n.bit_length()):
            break  # only cycles are left, and each has been gone round
    left = open_.withColumn("closed", F.lit(False))
    return left if closed is None else closed.withColumn("closed", F.lit(True)).unionByName(left)


def unitigs(kmers: DataFrame, kmer: str, k: int, max_rounds: int = 48, most_steps: int = 2_000_000) -> DataFrame:
    """(unitig, n_kmers): the maximal non-branching paths as text, each in one of its two directions (the lesser text).

    A closed cycle is cut before its least k-mer. ``kmers`` must be distinct canonical packed k-mers; nulls are left
    out. Paths are found by walking along neighbours that lie together, then by pointer doubling between these walks.
    """
    from .kmers import spell

    ws = Workspace(kmers.sparkSession, "unitigs")
    nodes = ws.write(kmers.where(F.col(kmer).isNotNull()).select(F.col(kmer).alias("node")).distinct(), "nodes")
    m = ws.write(mergeable(nodes, "node", k), "mergeable")
    # leaving a by a_end enters b by b_end, and the other way round: (oriented node, its predecessor)
    enter = lambda n, e: _oriented(F.col(n), F.col(e) == "L")
    leave = lambda n, e: _oriented(F.col(n), F.col(e) == "R")
    links = ws.write(m.select(enter("b", "b_end").alias("v"), leave("a", "a_end").alias("pred")).unionByName(m.select(enter("a", "a_end").alias("v"), leave("b", "b_end").alias("pred"))), "links")
    paths = ws.write(_jump(ws, links, "paths", k, max_rounds, most_steps), "paths")
    cyclic = paths.where("not closed")
    if cyclic.isEmpty():
        placed = paths.select("v", "head", "dist")
    else:
        # cut every cycle before its least oriented node; the mirror cycle has another one, and is the same unitig
        cut = cyclic.where(F.col("v") != F.col("low")).select("v").join(links, "v")
        again = _jump(ws, ws.write(cut, "cut"), "cycles", k, max_rounds, most_steps)
        placed = paths.where("closed").select("v", "head", "dist").unionByName(again.select("v", "head", "dist"))
    # nodes without a predecessor are heads themselves
    every = nodes.select(F.explode(F.array(F.shiftleft("node", 1), F.shiftleft("node", 1).bitwiseOR(F.lit(1)))).alias("v"))
    heads = every.join(placed.select("v"), "v", "left_anti").select("v", F.col("v").alias("head"), F.lit(0).cast("long").alias("dist"))
    placed = ws.write(placed.unionByName(heads), "placed")

    node, backward = F.shiftrightunsigned("v", 1), F.col("v").bitwiseAND(F.lit(1)) == 1
    value = F.when(backward, reverse_packed(node, k)).otherwise(node)
    last = F.substring(F.lit("ACGT"), (value.bitwiseAND(F.lit(3)) + 1).cast("int"), F.lit(1))
    piece = F.when(F.col("dist") == 0, spell(value, k)).otherwise(last)
    # a unitig is one string in the result, so its pieces are together here as well
    text = placed.groupBy("head").agg(F.sort_array(F.collect_list(F.struct("dist", piece.alias("s")))).alias("parts"), F.min(node).alias("low"), F.count(F.lit(1)).alias("n_kmers"))
    spelled = text.select("low", "n_kmers", F.array_join(F.col("parts.s"), "").alias("unitig"))
    # both directions of a path have the same least node; a cycle's two cuts differ, and the lesser text is kept
    return spelled.groupBy("low").agg(F.min("unitig").alias("unitig"), F.min("n_kmers").alias("n_kmers")).select("unitig", "n_kmers")
