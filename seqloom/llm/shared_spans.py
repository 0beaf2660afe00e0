"""Long exact spans shared between records.

Every window of ``width`` tokens gets a Rabin-Karp hash: a polynomial in a fixed base modulo the prime 2^61 - 1, put
together by doubling (windows of 1, 2, 4, ... tokens), so that a batch of records costs a few array operations a token.
The windows are written once.  They are counted in Spark with algebraic states (least and greatest record, one
occurrence that stands for the hash), so a window that stands in a third of all places costs one row per task.  Windows
of more than one record are matched back and compared, token by token, with the occurrence that stands for their hash;
neighbouring ones are compared as one stretch.  Hashes under which different windows met are counted once more by the
tokens themselves, so the result is exact.  Neighbouring or overlapping shared windows merge into maximal intervals.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.workspace import Workspace

PRIME = (1 << 61) - 1
_BASE = 0x1F3D5B79A2C4E681 % PRIME
_SEED = 0x243F6A8885A308D3
_LOW30, _LOW31 = np.uint64((1 << 30) - 1), np.uint64((1 << 31) - 1)
_P, _N30, _N31, _N61 = np.uint64(PRIME), np.uint64(30), np.uint64(31), np.uint64(61)


def _fold(x: np.ndarray) -> np.ndarray:
    """x modulo 2^61 - 1, for any 64-bit x."""
    x = (x & _P) + (x >> _N61)
    return np.where(x >= _P, x - _P, x)


def _times(x: np.ndarray, y: int) -> np.ndarray:
    """x * y modulo 2^61 - 1, of x and y below it, in halves of 31 bits so that no product leaves 64 bits."""
    yu, yd = np.uint64(y >> 31), np.uint64(y & (1 << 31) - 1)
    xu, xd = x >> _N31, x & _LOW31
    mid = xd * yu + xu * yd
    return _fold(((xu * yu) << np.uint64(1)) + (mid >> _N30) + ((mid & _LOW30) << _N31) + xd * yd)


def _residues(tokens: np.ndarray) -> np.ndarray:
    """Tokens with their bits mixed, modulo 2^61 - 1."""
    u = tokens.astype(np.int64).view(np.uint64) ^ np.uint64(_SEED)
    u = (u ^ (u >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    u = (u ^ (u >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return _fold(u ^ (u >> np.uint64(31)))


def window_hashes(tokens: np.ndarray, width: int) -> np.ndarray:
    """Hash of every window: sum of token * base^(width - 1 - j) modulo 2^61 - 1."""
    power, wide, acc, size, n = _residues(tokens), 1, None, 0, len(tokens)
    rest = width
    while rest:
        if rest & 1:
            if acc is None:
                acc, size = power[: n - wide + 1], wide
            else:
                keep = n - (size + wide) + 1
                acc = _fold(_times(acc[:keep], pow(_BASE, wide, PRIME)) + power[size : size + keep])
                size += wide
        rest >>= 1
        if rest:
            keep = max(n - 2 * wide + 1, 0)
            power = _fold(_times(power[:keep], pow(_BASE, wide, PRIME)) + power[wide : wide + keep])
            wide *= 2
    return acc.view(np.int64)


def _windows(width: int, invalid: int, mask: int):
    def run(batches):
        for b in batches:
            rows = b.num_rows
            lists = b.column(2)
            if not rows:
                continue
            lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            values = lists.flatten()
            values = values.fill_null(invalid) if values.null_count else values
            tokens = values.to_numpy(zero_copy_only=False)
            n = len(tokens)
            if n < width:
                continue
            start = np.zeros(rows + 1, np.int64)
            np.cumsum(lengths, out=start[1:])
            row = np.repeat(np.arange(rows), lengths)
            bad = np.zeros(n + 1, np.int64)
            np.cumsum(tokens == invalid, out=bad[1:])
            last = n - width + 1
            h = window_hashes(tokens, width)
            ok = np.flatnonzero((bad[width:] == bad[:last]) & (row[width - 1 :] == row[:last]))
            for i in range(0, len(ok), 100_000):
                at = ok[i : i + 100_000]
                of = pa.array(row[at])
                yield pa.RecordBatch.from_arrays([b.column(0).take(of), b.column(1).take(of), pa.array(at - start[row[at]]), pa.array(h[at] & mask)], ["rec", "row", "pos", "h"])

    return run


def shared_spans(df: DataFrame, rec: str, tokens: str, width: int = 32, invalid: int = -1, hot_share: float = 0.001, hash_bits: int = 61) -> DataFrame:
    """(rec, span_start, span_end): maximal runs of positions that lie in a window that another record has too.

    Rows with the same ``rec`` are one record, in which positions are counted row by row, and equal spans are
    reported once. Null records, null or short arrays have no windows; null tokens are invalid. ``hot_share``:
    windows with at least this share of all rows (at most 1 / hot_share of them) are matched back by broadcast,
    all others by a shuffle, so no window makes a long task. Fewer ``hash_bits`` only make more hashes meet.
    """
    ws = Workspace(df.sparkSession, "spans")
    usable = df.where(F.col(rec).isNotNull() & (F.size(tokens) >= width))
    records = ws.write(usable.select(F.col(rec).cast("long").alias("rec"), F.monotonically_increasing_id().alias("row"), F.col(tokens).cast("array<bigint>").alias("tokens")), "records")
    w = ws.write(records.mapInArrow(_windows(width, invalid, (1 << hash_bits) - 1), "rec long, row long, pos long, h long"), "windows")
    counted = w.groupBy("h").agg(F.min("rec").alias("a"), F.max("rec").alias("b"), F.count(F.lit(1)).alias("n"), F.min("row").alias("of_row"), F.min_by("pos", "row").alias("of_pos"))
    shared = ws.write(counted.where("a < b").drop("a", "b"), "shared")
    total = shared.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    limit = max(2, int(hot_share * total))
    hot, cold = shared.where(F.col("n") >= limit).drop("n"), shared.where(F.col("n") < limit).drop("n")
    hot = F.broadcast(hot)  # at most 1 / hot_share rows
    # hot windows leave the shuffled side by a broadcast anti join, the rest is joined by hash
    found = ws.write(w.join(hot, "h").unionByName(w.join(hot.select("h"), "h", "left_anti").join(cold, "h")), "found")
    met = ws.write(_met(found, records, width), "met")
    hits = found.select("rec", "pos") if met.isEmpty() else _by_tokens(found, met, records, width)
    by_rec = Window.partitionBy("rec").orderBy("pos")
    islands = (
        hits.distinct()
        .withColumn("new", F.coalesce((F.col("pos") > F.lag("pos").over(by_rec) + width).cast("int"), F.lit(0)))
        .withColumn("island", F.sum("new").over(by_rec))
    )
    return (
        islands.groupBy("rec", "island")
        .agg(F.min("pos").alias("span_start"), (F.max("pos") + (width - 1)).alias("span_end"))
        .select("rec", "span_start", "span_end")
    )


def _slice(pos: str, n) -> F.Column:
    return F.slice("tokens", (F.col(pos) + 1).cast("int"), n.cast("int"))


def _met(found: DataFrame, records: DataFrame, width: int) -> DataFrame:
    """(h) of windows that differ from the one that stands for their hash. Windows that follow each other and whose
    counterparts do as well are one stretch: one comparison of arrays."""
    w = Window.partitionBy("row").orderBy("pos")  # no longer than the row itself
    same = (F.lag("pos").over(w) == F.col("pos") - 1) & (F.lag("of_row").over(w) == F.col("of_row")) & (F.lag("of_pos").over(w) == F.col("of_pos") - 1)
    s = found.withColumn("new", (~F.coalesce(same, F.lit(False))).cast("int")).withColumn("stretch", F.sum("new").over(w))
    s = s.groupBy("row", "stretch").agg(F.min("pos").alias("pos"), F.min("of_row").alias("of_row"), F.min("of_pos").alias("of_pos"), F.count(F.lit(1)).alias("n"))
    s = s.where("row <> of_row or pos <> of_pos")
    size = F.col("n") + (width - 1)
    mine = s.join(records.select("row", "tokens"), "row").withColumn("mine", _slice("pos", size)).drop("tokens")
    both = mine.join(records.select(F.col("row").alias("of_row"), "tokens"), "of_row").where(F.col("mine") != _slice("of_pos", size))
    spans = both.select("row", F.col("pos").alias("first"), (F.col("pos") + F.col("n")).alias("end"))
    return found.join(spans, "row").where("pos >= first and pos < end").select("h").distinct()


def _by_tokens(found: DataFrame, met: DataFrame, records: DataFrame, width: int) -> DataFrame:
    """(rec, pos) of the shared windows, those of the hashes in ``met`` counted by their tokens."""
    again = found.join(met, "h").join(records.select("row", "tokens"), "row").select("rec", "pos", _slice("pos", F.lit(width)).alias("tokens"))
    shared = again.groupBy("tokens").agg(F.min("rec").alias("a"), F.max("rec").alias("b")).where("a < b").select("tokens")
    return found.join(met, "h", "left_anti").select("rec", "pos").unionByName(again.join(shared, "tokens", "left_semi").select("rec", "pos"))
