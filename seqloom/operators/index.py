"""Target index: k-mer classes of targets, equivalence classes, and counting of reads against an index.

A target is given either as an array of class ids (``transcripts.kmers``) or as a sequence that is tokenised.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.packing import buffers, packed_runs, reverse_packed, reverse_values, windows_of_runs
from ..functions.sequence import is_id, squeeze


def target_kmers(targets: DataFrame, tid: str, kmers: str) -> DataFrame:
    """(tid, kmer, occ): distinct k-mers of each target with their multiplicity. A target delivered more than once
    counts once, with its greatest multiplicity; null and -1 are no k-mers; null or empty arrays have none."""
    one = targets.where(F.col(tid).isNotNull()).select(F.col(tid).alias("tid"), kmers).distinct()
    e = one.select("tid", F.xxhash64(kmers).alias("v"), F.explode(kmers).alias("kmer")).where(is_id("kmer"))
    return e.groupBy("tid", "v", "kmer").agg(F.count(F.lit(1)).alias("occ")).groupBy("tid", "kmer").agg(F.max("occ").alias("occ"))


def inverted(tk: DataFrame) -> DataFrame:
    """(kmer, n_targets, n_occ): the inverted index in counts; lists of targets are never collected for it."""
    return tk.groupBy("kmer").agg(F.count(F.lit(1)).alias("n_targets"), F.sum("occ").alias("n_occ"))


def equivalence_classes(tk: DataFrame) -> DataFrame:
    """(kmer, class_key): k-mers with equal (target, multiplicity) vectors share the class; its key is its least k-mer.

    The vector of a k-mer is reduced to two order-free 64-bit sums of hashes, its size and its sum of
    multiplicities, all of them combined map-side, so a k-mer of millions of targets is never one long array.
    """
    item = lambda seed: F.xxhash64(F.lit(seed), "tid", "occ").cast("decimal(38,0)")
    sig = tk.groupBy("kmer").agg(F.sum(item(1)).alias("a"), F.sum(item(2)).alias("b"), F.count(F.lit(1)).alias("n"), F.sum("occ").alias("o"))
    keys = sig.groupBy("a", "b", "n", "o").agg(F.min("kmer").alias("class_key"))
    # a class of a third of all k-mers makes one hot join key; adaptive execution splits it
    return sig.join(keys, ["a", "b", "n", "o"]).select("kmer", "class_key")


def class_targets(tk: DataFrame, classes: DataFrame) -> DataFrame:
    """(class_key, tid, occ): the vector of each class, taken from its key k-mer."""
    keys = classes.select("class_key").distinct()
    return tk.join(keys, tk.kmer == keys.class_key).select("class_key", "tid", "occ")


def class_counts(classes: DataFrame, tk: DataFrame, counts: DataFrame) -> DataFrame:
    """(class_key, cnt, size, promiscuity): summed counts of the class's k-mers, the number of them that were counted
    at all, and the number of targets. ``counts``: (kmer, cnt); classes without counts have cnt and size 0."""
    per = classes.join(counts.where("cnt > 0"), "kmer", "left").groupBy("class_key").agg(F.coalesce(F.sum("cnt"), F.lit(0)).alias("cnt"), F.count("cnt").alias("size"))
    promiscuity = class_targets(tk, classes).groupBy("class_key").agg(F.count(F.lit(1)).alias("promiscuity"))
    return per.join(promiscuity, "class_key")


def idf(promiscuity: Column, n_targets: Column) -> Column:
    """ln(number of targets / number of targets with the k-mer)."""
    return F.log(n_targets / promiscuity)


def reverse_is_used(fwd: Column, rev: Column, skipped: Column | None = None) -> Column:
    """Strand of an unstranded read from its index hits: the reverse k-mers count only if there are more of them than
    forward ones plus ``skipped``, the windows that were never formed for symbols that are no base; ties go forward."""
    return rev > (fwd if skipped is None else fwd + skipped)


def window_hits(tokens: DataFrame, row_id: str, index: DataFrame, k: int, how: str = "inner") -> DataFrame:
    """(row_id, fwd, rev): the k-mers of each window that stand in an index of non-canonical k-mers, null on the strand that does not; with
    ``how`` left also the windows that have none.

    ``tokens``: row_id, fwd, rev of :func:`kmers.tokenise`; ``index``: kmer, one row a k-mer.  The index is folded to canonical k-mers
    with a mark for either strand, so a window is one row and is looked up once for both strands.
    """
    folded = (
        index.select("kmer", reverse_packed(F.col("kmer"), k).alias("other"))
        .groupBy(F.least("kmer", "other").alias("canon")).agg(F.max(F.col("kmer") <= F.col("other")).alias("as_is"), F.max(F.col("kmer") >= F.col("other")).alias("turned"))
    )
    w = tokens.select(row_id, "fwd", "rev", F.least("fwd", "rev").alias("canon")).join(folded, "canon", how)
    f = F.col("fwd") <= F.col("rev")
    return w.select(row_id, F.when(F.when(f, F.col("as_is")).otherwise(F.col("turned")), F.col("fwd")).alias("fwd"), F.when(F.when(f, F.col("turned")).otherwise(F.col("as_is")), F.col("rev")).alias("rev"))


def read_hits(tokens: DataFrame, row_id: str, index: DataFrame, k: int) -> DataFrame:
    """(row_id, n_fwd, n_rev, n_windows) of each read with a window: its hits in an index, see :func:`window_hits`."""
    return window_hits(tokens, row_id, index, k, "left").groupBy(row_id).agg(F.count("fwd").alias("n_fwd"), F.count("rev").alias("n_rev"), F.count(F.lit(1)).alias("n_windows"))


def read_hits_among(reads: DataFrame, row_id: str, seq: str, member: Column, k: int, carry: Column | None = None) -> DataFrame:
    """:func:`read_hits` of ``reads`` in the index of the k-mers of those of them for which ``member`` holds.

    Windows are not shuffled one by one: runs of them that share a minimizer go packed to the task of that minimizer, those of the
    index first, and only the numbers of hits of a run come back. A window is so some three bytes of shuffle, not a row. ``carry``: one
    more number of a read, from 0 to 2^53, that comes out as ``carry`` without a join.
    """
    names = ["key", row_id, "info", "x", "y"]

    def cut(batches):
        for b in batches:
            key, row, _, size, x, y = packed_runs(*buffers(b.column(1)), k)
            other = ~b.column(2).fill_null(False).to_numpy(zero_copy_only=False)
            info = (other.astype(np.int64) << 60 | b.column(3).to_numpy() << 5)[row] | size
            for i in range(0, len(row), 50_000):
                j = slice(i, i + 50_000)
                yield pa.RecordBatch.from_arrays([pa.array(key[j]), b.column(0).take(pa.array(row[j])), pa.array(info[j]), pa.array(x[j]), pa.array(y[j])], names)

    def look_up(batches):
        own, index = [], None

        def hits(b):
            info, x, y = (b.column(i).to_numpy() for i in (2, 3, 4))
            size = info & 31
            begin = np.r_[0, np.cumsum(size)[:-1]]
            w, _ = windows_of_runs(x, y, size, k)
            found = []
            for v in (w, reverse_values(w, k)):
                at = np.searchsorted(index, v)
                there = index[np.minimum(at, len(index) - 1)] == v if len(index) else np.zeros(len(v), bool)
                found.append(np.add.reduceat(there.astype(np.int64), begin))
            counts = found[0] << 42 | found[1] << 21 | size  # at most 31 each
            return pa.RecordBatch.from_arrays([b.column(1), pa.array(counts), pa.array((info & ((1 << 60) - 1)) >> 5)], [row_id, "counts", "carry"])

        def indexed():
            parts = [np.unique(windows_of_runs(b.column(3).to_numpy(), b.column(4).to_numpy(), b.column(2).to_numpy() & 31, k)[0]) for b in own]
            return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.int64)

        for b in batches:
            n = int((b.column(2).to_numpy() >> 60 == 0).sum())  # the index comes first
            if n:
                own.append(b.slice(0, n))
            if n < b.num_rows:
                if index is None:
                    index = indexed()
                    yield from map(hits, own)
                yield hits(b.slice(n))
        if index is None and own:
            index = indexed()
            yield from map(hits, own)

    cols = [F.col(row_id).cast("long").alias(row_id), squeeze(seq).alias("seq"), member.alias("member"), F.coalesce(F.lit(0) if carry is None else carry, F.lit(0)).cast("long").alias("carry")]
    runs = reads.select(*cols).mapInArrow(cut, f"key int, `{row_id}` long, info long, x long, y long")
    found = runs.repartition("key").sortWithinPartitions("info").mapInArrow(look_up, f"`{row_id}` long, counts long, carry long")
    part = lambda at: F.sum(F.shiftright("counts", at).bitwiseAND(F.lit((1 << 21) - 1)))
    return found.groupBy(row_id).agg(part(42).alias("n_fwd"), part(21).alias("n_rev"), part(0).alias("n_windows"), *([] if carry is None else [F.max("carry").alias("carry")]))


def count_by_strand(hits: DataFrame, row_id: str) -> DataFrame:
    """(kmer, cnt) of the written hits (row_id, fwd, rev) of windows: each read counts on the strand with more hits, the forward one
    of two alike. Windows without a hit change nothing and need not be among them."""
    strand = hits.groupBy(row_id).agg(reverse_is_used(F.count("fwd"), F.count("rev")).alias("r"))
    used = hits.join(strand, row_id).select(F.when(F.col("r"), F.col("rev")).otherwise(F.col("fwd")).alias("kmer")).where("kmer is not null")
    return used.groupBy("kmer").agg(F.count(F.lit(1)).alias("cnt"))


def composition(df: DataFrame, name: str, seq: str, compat: bool = True) -> DataFrame:
    """(name, length, gc, di_00..di_15): GC fraction and counts of the 16 dinucleotides (A0 C1 G2 T3, first base high).

    With ``compat`` the GC fraction counts the second bases of valid dinucleotides and the last base once more, over
    the length, as the published numbers do; without, it is the number of G and C over the length.  Sequences
    shorter than two bases have zeros throughout, null ones are left out.
    """
    s = F.col("__s")
    df = df.where(F.col(seq).isNotNull()).select(F.col(name).alias("name"), F.upper(F.col(seq)).alias("__s"))
    # pairs at even and at odd positions, so that overlapping ones are all counted without a window per base
    n = F.length(s)
    gc_all = n - F.length(F.translate(s, "GC", ""))
    pairs = {a + b: (F.length(F.regexp_replace(s, f"{a}(?={b})", "__")) - n) for a in "ACGT" for b in "ACGT"}
    second = sum((pairs[p] for p in pairs if p[1] in "GC"), F.lit(0))
    last = F.right(s, F.lit(1)).isin("G", "C").cast("int")
    gc = (second + last) / n if compat else gc_all / n
    short = n < 2
    return df.select(
        "name",
        n.alias("length"),
        F.when(short, F.lit(0.0)).otherwise(gc).alias("gc"),
        *(F.when(short, F.lit(0)).otherwise(c).cast("int").alias(f"di_{i:02d}") for i, c in enumerate(pairs.values())),
    )
