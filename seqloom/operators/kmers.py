"""k-mers of reads: tokenise, count, filter, weigh, and signatures.

k of at most 31 goes through packed longs (see functions/packing.py): tokenising is one pass over Arrow buffers,
and what is shuffled is 8 bytes a k-mer, combined per batch before.  Greater k (up to 256) goes through string
windows inside the JVM, cut from chunks so that each substring call is short.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..functions import mmers
from ..functions.packing import MAX_PACKED, buffers, packed_windows
from ..functions.sequence import canonical as canonical_text
from ..functions.sequence import squeeze


def spell(packed: Column | str, k: int) -> Column:
    """Text of a packed k-mer."""
    c = F.col(packed) if isinstance(packed, str) else packed
    return F.lpad(F.translate(F.conv(c.cast("string"), 10, 4), "0123", "ACGT"), k, "A")


def pack(kmer: Column | str) -> Column:
    """Packed k-mer of a text of at most 31 bases; null if it holds anything else."""
    c = F.col(kmer) if isinstance(kmer, str) else kmer
    return F.when(c.rlike(f"^[ACGT]{{1,{MAX_PACKED}}}$"), F.conv(F.translate(c, "ACGT", "0123"), 4, 10).cast("long"))


def tokenise(df: DataFrame, row_id: str, seq: str, k: int, length: str | None = None) -> DataFrame:
    """(row_id, pos, fwd, rev): each window of k bases, packed, with its reverse complement. Windows with anything
    but bases are dropped, null sequences have none. ``row_id`` must be a long. ``length`` names one more column
    for the length of the sequence, which saves joining it to the windows later."""
    extra = [length] if length else []

    def run(batches):
        for b in batches:
            offsets, raw = buffers(b.column(1))
            fwd, rev, row, pos = packed_windows(offsets, raw, k)
            size = np.diff(offsets).astype(np.int32)
            for i in range(0, len(fwd), 200_000):
                j = slice(i, i + 200_000)
                cols = [b.column(0).take(pa.array(row[j])), pa.array(pos[j].astype(np.int32)), pa.array(fwd[j]), pa.array(rev[j])]
                yield pa.RecordBatch.from_arrays([*cols, *(pa.array(size[row[j]]) for _ in extra)], [row_id, "pos", "fwd", "rev", *extra])

    schema = f"`{row_id}` long, pos int, fwd long, rev long" + "".join(f", `{c}` int" for c in extra)
    return df.select(F.col(row_id).cast("long").alias(row_id), squeeze(seq).alias("seq")).mapInArrow(run, schema)


def count_kmers(df: DataFrame, seq: str, k: int, both_strands: bool = True) -> DataFrame:
    """(kmer packed, cnt). Each Arrow batch is combined before it leaves the Python worker."""

    def run(batches):
        for b in batches:
            fwd, rev, _, _ = packed_windows(*buffers(b.column(0)), k)
            x, n = np.unique(np.minimum(fwd, rev) if both_strands else fwd, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(n)], ["kmer", "cnt"])

    return df.select(squeeze(seq).alias("seq")).mapInArrow(run, "kmer long, cnt long").groupBy("kmer").agg(F.sum("cnt").alias("cnt"))


def tokenise_text(df: DataFrame, row_id: str, seq: str, k: int, chunk: int = 256) -> DataFrame:
    """(row_id, kmer): canonical k-mers as text, any k; sequences are cut at other symbols, then into overlapping chunks."""
    pieces = df.select(F.col(row_id), F.explode(F.split(squeeze(seq), "[^ACGT]+")).alias("s")).where(F.length("s") >= k)
    starts = F.sequence(F.lit(1), F.length("s") - F.lit(k - 1), F.lit(chunk))
    chunks = pieces.select(row_id, F.explode(F.transform(starts, lambda i: F.substring("s", i, F.lit(chunk + k - 1)))).alias("s"))
    at = F.sequence(F.lit(1), F.length("s") - F.lit(k - 1))
    return chunks.select(row_id, "s", F.explode(at).alias("i")).select(row_id, canonical_text(F.substring("s", F.col("i"), F.lit(k))).alias("kmer"))


def cut_off(counts: DataFrame, ci: int = 2, cx: int = 1_000_000_000, cs: int = 255) -> DataFrame:
    """Keep k-mers counted from ci to cx times, then cap the count at cs. Sums over the result are not total occurrences."""
    return counts.where(F.col("cnt").between(ci, cx)).withColumn("cnt", F.least("cnt", F.lit(cs).cast("long")))


def statistics(counts: DataFrame, ci: int, cx: int) -> DataFrame:
    """One row: distinct k-mers, those below ci and above cx, those kept, and all occurrences."""
    c = F.col("cnt")
    return counts.agg(
        F.count_if(c < ci).alias("n_below_min"),
        F.count_if(c > cx).alias("n_above_max"),
        F.count(F.lit(1)).alias("n_unique"),
        F.count_if(c.between(ci, cx)).alias("n_unique_counted"),
        F.coalesce(F.sum("cnt"), F.lit(0)).alias("n_total"),
    )


def weighted_kmers(df: DataFrame, seq: str, quals: str, k: int, least: float = 0.0) -> DataFrame:
    """(kmer packed, weight): canonical k-mers with the sum, over their windows, of the product of the probabilities
    that the bases are right.  ``quals``: phred values, one per base; rows with fewer or more have no k-mers."""

    def run(batches):
        for b in batches:
            offsets, raw = buffers(b.column(0))
            q = b.column(1)
            fwd, rev, row, pos = packed_windows(offsets, raw, k)
            lengths = q.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            good = (lengths == np.diff(offsets))[row]
            p = mmers.probability_right(q.flatten().fill_null(0).to_numpy(zero_copy_only=False))
            starts = np.concatenate(([0], np.cumsum(lengths)))
            at = (starts[row] + pos)[good]
            w = np.ones(len(at))
            for j in range(k):
                w *= p[at + j]
            x = np.minimum(fwd, rev)[good]
            kept = w > least if least else np.ones(len(w), bool)
            x, where = np.unique(x[kept], return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(np.bincount(where, w[kept], len(x)))], ["kmer", "weight"])

    tokens = df.select(squeeze(seq).alias("seq"), F.col(quals).cast("array<int>").alias("q")).mapInArrow(run, "kmer long, weight double")
    return tokens.groupBy("kmer").agg(F.sum("weight").alias("weight"))


def signature(packed: Column | str, k: int, m: int) -> Column:
    """Least normalised m-mer of a packed k-mer; 4^m stands for 'none allowed'."""
    table = mmers.normalised(m)

    @pandas_udf("int")
    def of(x):
        v = x.to_numpy(np.int64)
        out = np.full(len(v), 4**m, np.int64)
        for j in range(k - m + 1):
            np.minimum(out, table[(v >> (2 * j)) & (4**m - 1)], out=out)
        return x.__class__(out.astype(np.int32))

    return of(packed)


def super_kmers(df: DataFrame, row_id: str, seq: str, k: int, m: int, most: int = 255) -> DataFrame:
    """(row_id, start, len, signature): maximal stretches of consecutive k-mers with the same signature. A stretch is
    also cut when it is k + ``most`` bases long."""
    table = mmers.normalised(m)

    def run(batches):
        for b in batches:
            offsets, raw = buffers(b.column(1))
            fwd, _, row, pos = packed_windows(offsets, raw, k)
            if not len(fwd):
                continue
            best = np.full(len(fwd), 4**m, np.int64)
            for j in range(k - m + 1):
                np.minimum(best, table[(fwd >> (2 * j)) & (4**m - 1)], out=best)
            broken = (row[1:] != row[:-1]) | (pos[1:] != pos[:-1] + 1) | (best[1:] != best[:-1])
            first = np.flatnonzero(np.concatenate(([True], broken)))
            size = np.diff(np.concatenate((first, [len(fwd)])))
            cut = most + 1
            parts = -(-size // cut)
            idx = np.repeat(first, parts) + cut * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
            end = np.minimum(np.repeat(first + size, parts), idx + cut)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(row[idx])), pa.array(pos[idx].astype(np.int32)), pa.array((end - idx + k - 1).astype(np.int32)), pa.array(best[idx].astype(np.int32))],
                [row_id, "start", "len", "signature"],
            )

    return df.select(F.col(row_id).cast("long").alias(row_id), squeeze(seq).alias("seq")).mapInArrow(run, f"`{row_id}` long, start int, len int, signature int")


def mmer_histogram(kmers: DataFrame, kmer: str, k: int, m: int) -> DataFrame:
    """(code, cnt): windows of m bases over a list of packed k-mers; code has the first base in its lowest bits. At most 4^m rows."""

    def run(batches):
        total = np.zeros(4**m, np.int64)
        for b in batches:
            v = b.column(0).to_numpy()
            for j in range(k - m + 1):
                total += np.bincount((v >> (2 * j)) & (4**m - 1), minlength=4**m)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(mmers.little_endian(at, m)), pa.array(total[at])], ["code", "cnt"])

    return kmers.select(F.col(kmer).cast("long")).mapInArrow(run, "code long, cnt long").groupBy("code").agg(F.sum("cnt").alias("cnt"))


def node_minimizers(kmers: DataFrame, kmer: str, k: int, m: int, ranks: dict[int, int]) -> DataFrame:
    """kmers with left_min and right_min: the least rank over the m-mers, on both strands, of the middle (all but the
    first and last base) and of the leftmost, respectively rightmost, m bases. ``ranks``: code -> rank, at most 4^m
    entries; m-mers without a rank have rank 0."""
    by_code = np.zeros(4**m, np.int64)
    for code, rank in ranks.items():
        by_code[code] = rank
    codes = np.arange(4**m)
    by_value = by_code[mmers.little_endian(codes, m)]
    both = np.minimum(by_value, by_value[mmers.reverse_value(codes, m)])

    def least(v: np.ndarray, first: int, last: int) -> np.ndarray:
        out = np.full(len(v), np.iinfo(np.int64).max)
        for j in range(first, last + 1):
            np.minimum(out, both[(v >> (2 * (k - m - j))) & (4**m - 1)], out=out)
        return out

    def run(batches):
        for b in batches:
            v = b.column(0).to_numpy()
            middle = least(v, 1, k - m - 1)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(np.minimum(least(v, 0, 0), middle)), pa.array(np.minimum(least(v, k - m, k - m), middle))], ["kmer", "left_min", "right_min"]
            )

    return kmers.select(F.col(kmer).cast("long")).mapInArrow(run, "kmer long, left_min long, right_min long")
