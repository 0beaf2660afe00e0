"""Mapping of reads to target sequences: seeds, maximal exact matches, vote clusters, best locations, mate pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import libfmt
from . import kmers as K


def seeds(reads: DataFrame, read_id: str, seq: str, targets: DataFrame, tid: str, tseq: str, k: int = 19, max_occ: int | None = 200) -> DataFrame:
    """(read_id, tid, fwd, rpos, tpos, qpos): positions where a k-mer of the read, or of its reverse complement, stands in a target.

    ``rpos`` counts in the direction in which the read matches, ``qpos`` from the start of the read. Of a seed with n occurrences
    in the targets, more than ``max_occ``, those stay whose tid + tpos is a multiple of ceil(n / max_occ): a stride along the
    targets that needs no sort, so no seed's occurrences are gathered in one task; None keeps all. After that a seed joins at
    most some max_occ rows to each of its reads, and adaptive execution splits the reads of a frequent one.
    """
    r = read_windows(reads, read_id, seq, k)
    t = K.tokenise(targets, tid, tseq, k).select("fwd", "rev", F.col(tid), F.col("pos").alias("tpos"))
    if max_occ is not None:
        t = stride(t, tid, t.groupBy("fwd").agg(F.count(F.lit(1)).alias("n_occ")).where(F.col("n_occ") > max_occ), max_occ)
    return meet(r, t, read_id, tid, k)


def read_windows(reads: DataFrame, read_id: str, seq: str, k: int) -> DataFrame:
    """(read_id, qpos, n, kmer, rf): windows of reads, their canonical k-mer and the one as read."""
    return K.tokenise(reads, read_id, seq, k, length="n").select(read_id, F.col("pos").alias("qpos"), "n", F.least("fwd", "rev").alias("kmer"), F.col("fwd").alias("rf"))


def stride(t: DataFrame, tid: str, many: DataFrame, max_occ: int) -> DataFrame:
    """Windows of targets (tid, tpos, fwd, ...) without those that the stride of their frequent seed (``many``: fwd, n_occ) leaves out."""
    step = F.ceil(F.coalesce("n_occ", F.lit(1)) / F.lit(max_occ))
    return t.join(many, "fwd", "left").where(F.pmod(F.col(tid) + F.col("tpos"), step) == 0)


def meet(r: DataFrame, t: DataFrame, read_id: str, tid: str, k: int) -> DataFrame:
    """:func:`seeds` of windows of reads (read_id, qpos, n, kmer, rf) and of targets (tid, tpos, fwd, rev)."""
    # both strands meet under the canonical k-mer, so a window is one row
    t = t.select(tid, "tpos", F.least("fwd", "rev").alias("kmer"), F.col("fwd").alias("tf"), F.col("rev").alias("tr"))
    hits = r.join(t, "kmer")
    same = F.array_compact(F.array(F.when(F.col("rf") == F.col("tf"), F.lit(True)), F.when(F.col("rf") == F.col("tr"), F.lit(False))))
    hits = hits.select(read_id, tid, F.explode(same).alias("fwd"), "qpos", "tpos", "n") if k % 2 == 0 else hits.withColumn("fwd", F.col("rf") == F.col("tf"))
    return hits.select(read_id, tid, "fwd", F.when(F.col("fwd"), F.col("qpos")).otherwise((F.col("n") - k - F.col("qpos")).cast("int")).alias("rpos"), "tpos", "qpos")


def exact_matches(hits: DataFrame, read_id: str, tid: str, k: int) -> DataFrame:
    """(read_id, tid, fwd, rpos, tpos, qpos, len): seeds on one diagonal at consecutive positions, joined to maximal matches."""
    w = Window.partitionBy(read_id, tid, "fwd", "diag").orderBy("rpos")
    d = hits.withColumn("diag", F.col("tpos") - F.col("rpos"))
    d = d.withColumn("new", F.coalesce((F.col("rpos") != F.lag("rpos").over(w) + 1).cast("int"), F.lit(1))).withColumn("run", F.sum("new").over(w))
    m = d.groupBy(read_id, tid, "fwd", "diag", "run").agg(F.min("rpos").alias("rpos"), F.min("tpos").alias("tpos"), F.min("qpos").alias("qpos"), (F.count(F.lit(1)) + (k - 1)).cast("int").alias("len"))
    return m.select(read_id, tid, "fwd", "rpos", "tpos", "qpos", "len")


def super_maximal(matches: DataFrame, read_id: str) -> DataFrame:
    """The matches whose stretch of the read lies in no longer match of the read, on any target and strand.

    Only the longest match from each position of a read can be one, and only if it ends beyond those that begin before it; so
    what is ordered is at most a row a position of the read. ``matches`` should be a written table, as it is read twice.
    """
    w = Window.partitionBy(read_id).orderBy("qpos").rowsBetween(Window.unboundedPreceding, -1)
    longest = matches.groupBy(read_id, "qpos").agg(F.max(F.col("qpos") + F.col("len")).alias("end"))
    kept = longest.withColumn("before", F.max("end").over(w)).where("before is null or before < end").select(read_id, "qpos", (F.col("end") - F.col("qpos")).cast("int").alias("len"))
    return matches.join(kept, [read_id, "qpos", "len"], "left_semi")


def anchors(sorted_positions: Column, gap: int = 10) -> Column:
    """Anchors of clusters in a sorted array of votes: a vote more than ``gap`` beyond the current anchor is the next one."""
    return F.aggregate(sorted_positions, F.slice(sorted_positions, 1, 1), lambda a, x: F.when(x - F.element_at(a, -1) > gap, F.array_append(a, x)).otherwise(a))


def clusters(matches: DataFrame, read_id: str, tid: str, gap: int = 10) -> DataFrame:
    """(read_id, tid, fwd, anchor, coverage): votes (tpos - rpos) gathered into anchored clusters; coverage adds, in order
    of vote and read position, the bases of each match beyond the end of the one before it."""
    v = matches.withColumn("vote", F.col("tpos") - F.col("rpos"))
    keys = [read_id, tid, "fwd"]
    # distinct diagonals of one read in one target: bounded by the read and the target, not by the data
    a = v.groupBy(*keys).agg(F.array_sort(F.collect_set("vote")).alias("votes")).select(*keys, anchors(F.col("votes"), gap).alias("anchors"))
    v = v.join(a, keys).withColumn("anchor", F.array_max(F.filter("anchors", lambda x: x <= F.col("vote")))).drop("anchors")
    w = Window.partitionBy(*keys, "anchor").orderBy("vote", "rpos")
    end = F.col("tpos") + F.col("len")
    v = v.withColumn("gain", F.least(F.col("len"), end - F.coalesce(F.lag(end).over(w), F.lit(0))))
    return v.groupBy(*keys, "anchor").agg(F.sum("gain").alias("coverage"))


def kernel_locations(matches: DataFrame, read_id: str, tid: str, lengths: DataFrame, reach: int = 4) -> DataFrame:
    """(read_id, tid, fwd, pos, score): the place where votes (tpos - rpos) add up to most, each spread over its neighbourhood, from
    ``reach`` before it to ``reach`` - 1 after it, by exp(-d^2 / 60) times its length; of ties the lesser place. Votes and places before
    the start or beyond the end of the target are none. ``lengths``: tid, n."""
    v = matches.select(read_id, tid, "fwd", (F.col("tpos") - F.col("rpos")).alias("vote"), "len").where("vote >= 0")
    v = v.select(read_id, tid, "fwd", "vote", "len", F.explode(F.sequence(F.lit(-reach), F.lit(reach - 1))).alias("d")).withColumn("pos", F.col("vote") + F.col("d"))
    v = v.join(lengths, tid).where((F.col("pos") >= 0) & (F.col("pos") < F.col("n")))
    # rounded, so that the order of a sum does not decide between ties
    at = v.groupBy(read_id, tid, "fwd", "pos").agg(F.round(F.sum(F.exp(-F.col("d") * F.col("d") / 60.0) * F.col("len")), 9).alias("score"))
    best = F.max(F.struct("score", (-F.col("pos")).alias("p"))).alias("b")
    return at.groupBy(read_id, tid, "fwd").agg(best).select(read_id, tid, "fwd", (-F.col("b.p")).alias("pos"), F.col("b.score").alias("score"))


def best_locations(cl: DataFrame, read_id: str, tid: str, lengths: DataFrame) -> DataFrame:
    """(read_id, tid, fwd, pos, coverage, score): the cluster of greatest coverage; forward wins ties, then the lesser
    position. ``lengths``: read_id, n; score is coverage over n."""
    order = F.struct(F.col("coverage"), F.col("fwd"), (-F.col("anchor")).alias("a"))
    b = cl.groupBy(read_id, tid).agg(F.max(order).alias("b")).join(lengths, read_id)
    return b.select(read_id, tid, F.col("b.fwd").alias("fwd"), (-F.col("b.a")).alias("pos"), F.col("b.coverage").alias("coverage"), (F.col("b.coverage") / F.col("n")).alias("score"))


def limit_hits(best: DataFrame, read_id: str, most: int = 100) -> DataFrame:
    """Without the reads that have more than ``most`` targets: their number comes from an aggregation, not a window."""
    many = best.groupBy(read_id).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select(read_id)
    return best.join(many, read_id, "left_anti")


def mate_pairs(left: DataFrame, right: DataFrame, pair: str, tid: str, cut: float = 0.75) -> DataFrame:
    """(pair, tid, frag_len, score, format): targets that both mates hit with at least the given coverage.

    ``left``, ``right``: pair, tid, fwd, pos, score, n (read length)."""
    a = left.where(F.col("score") >= cut).select(pair, tid, *(F.col(c).alias(f"{c}1") for c in ("fwd", "pos", "score", "n")))
    b = right.where(F.col("score") >= cut).select(pair, tid, *(F.col(c).alias(f"{c}2") for c in ("fwd", "pos", "score", "n")))
    start = lambda i: F.when(F.col(f"fwd{i}"), F.col(f"pos{i}")).otherwise(F.col(f"pos{i}") + F.col(f"n{i}"))
    return a.join(b, [pair, tid]).select(
        pair, tid, (F.abs(F.col("pos1") - F.col("pos2")) + F.col("n2")).alias("frag_len"), ((F.col("score1") + F.col("score2")) / 2).alias("score"),
        libfmt.of_pair(start(1), F.col("fwd1"), start(2), F.col("fwd2")).alias("format"),
    )


def bases_covered(hits: DataFrame, keys: list[str], pos: str, k: int = 20) -> DataFrame:
    """(keys, covered): sum over sorted positions of the distance to the one before (0 at first), at most k."""
    w = Window.partitionBy(*keys).orderBy(pos)
    h = hits.withColumn("__d", F.least(F.col(pos) - F.coalesce(F.lag(pos).over(w), F.lit(0)), F.lit(k)))
    return h.groupBy(*keys).agg(F.sum("__d").alias("covered"))
