"""Streams: reads that arrive as files, and mini-batch estimation of abundances.

The state is one row a target.  A batch of hits (read_id, tid) is divided among the targets of each read in proportion
to mass / length, summed per target, and added to the mass with a weight that grows by the forgetting schedule, so
that later batches, judged with better masses, weigh more.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.sequence import log_add
from ..plans.workspace import Workspace


def stream_fasta(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    """(name, seq) of FASTA files as they arrive in a folder."""
    raw = spark.readStream.option("lineSep", "\n>").option("maxFilesPerTrigger", files_per_trigger).text(folder)
    r = raw.select(F.regexp_replace("value", "^>", "").alias("r")).where(F.trim("r") != "")
    return r.select(F.split(F.split("r", "\n", 2)[0], " ", 2)[0].alias("name"), F.regexp_replace(F.split("r", "\n", 2)[1], "[\r\n]", "").alias("seq"))


class OnlineAbundance:
    """Mini-batch estimation. ``targets``: tid, length; a length that is null or below 1 counts as 1.

    Hits on unknown targets are ignored; a read's repeated hits on a target count once; an empty batch still counts
    in the schedule. Hits may have a column ``log_p``, the log-probability of the alignment itself (mapping quality,
    format, fragment length); it is added to that of the target, a null is probability 0, and of repeated hits the
    most probable one counts.
    """

    def __init__(self, targets: DataFrame, forgetting: float = 0.65, prior: float = 0.005):
        self.ws = Workspace(targets.sparkSession, "online")
        self.forgetting, self.step, self.log_weight = forgetting, 0, 0.0
        length = F.greatest(F.coalesce(F.col("length").cast("double"), F.lit(1.0)), F.lit(1.0))
        self.state = self.ws.write(targets.groupBy("tid").agg(F.max(length).alias("length")).withColumn("log_mass", F.log(F.lit(prior) * F.col("length"))), "state-0")

    def update(self, hits: DataFrame) -> None:
        self.step += 1
        n = self.step
        if n > 1:
            self.log_weight += self.forgetting * math.log(n - 1) - math.log(n**self.forgetting - 1)
        if "log_p" in hits.columns:
            h = hits.where(F.col("log_p").isNotNull()).groupBy("read_id", "tid").agg(F.max("log_p").alias("log_p"))
        else:
            h = hits.select("read_id", "tid").distinct().withColumn("log_p", F.lit(0.0))
        p = h.join(self.state, "tid").select("read_id", "tid", (F.col("log_mass") - F.log("length") + F.col("log_p")).alias("l"))
        most = p.groupBy("read_id").agg(F.max("l").alias("m"), F.collect_list("l").alias("all"))
        # the logarithm of a sum over one read's targets, which are bounded by the hit filter
        norm = most.select("read_id", (F.col("m") + F.log(F.aggregate("all", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("m"))))).alias("norm"))
        batch = p.join(norm, "read_id").groupBy("tid").agg(F.log(F.sum(F.exp(F.col("l") - F.col("norm")))).alias("b"))
        new = self.state.join(batch, "tid", "left").select("tid", "length", log_add(F.col("log_mass"), F.col("b") + F.lit(self.log_weight)).alias("log_mass"))
        old, self.state = n - 1, self.ws.write(new, f"state-{n}")
        self.ws.drop(f"state-{old}")

    def update_in_order(self, hits: DataFrame, batch: str, numbers: Iterable[int], most_targets: int = 8_000_000) -> None:
        """:meth:`update` with the hits of each batch of ``numbers`` (ascending), as the column ``batch`` has them; those of no such batch are ignored.

        Up to ``most_targets`` targets (24 bytes each) all batches run inside one task over the hits in order of batch, as a batch then
        costs its hits and not a pass over the state; beyond that every batch is a query over tables. Both take the same steps.
        """
        numbers = list(numbers)
        if not numbers:
            return
        hits = hits.where(F.col(batch).between(numbers[0], numbers[-1]))
        longs = all(d.schema[c].dataType.typeName() in ("long", "integer") for d, c in ((self.state, "tid"), (hits, "tid"), (hits, "read_id")))
        if not longs or self.state.count() > most_targets:
            for b in numbers:
                self.update(hits.where(F.col(batch) == b))
            return
        weights = {}
        for b in numbers:
            self.step += 1
            if self.step > 1:
                self.log_weight += self.forgetting * math.log(self.step - 1) - math.log(self.step**self.forgetting - 1)
            weights[b] = self.log_weight
        log_p = F.col("log_p") if "log_p" in hits.columns else F.lit(0.0)
        rows = hits.where("tid is not null").select(F.col(batch).cast("long").alias("batch"), F.col("read_id").cast("long").alias("read_id"), F.col("tid").cast("long").alias("tid"), log_p.cast("double").alias("x"), F.lit(0.0).alias("y"))
        start = self.state.where("tid is not null").select(F.lit(None).cast("long").alias("batch"), F.lit(None).cast("long").alias("read_id"), F.col("tid").cast("long").alias("tid"), F.col("log_mass").alias("x"), F.col("length").alias("y"))

        def run(arrow):
            yield from _in_order(arrow, weights)

        rows = rows.where("x is not null and read_id is not null").unionByName(start).repartition(1).sortWithinPartitions(F.col("batch").asc_nulls_first(), F.col("tid"))
        new = rows.mapInArrow(run, "tid long, length double, log_mass double").select(F.col("tid").cast(self.state.schema["tid"].dataType).alias("tid"), "length", "log_mass")
        self.state = self.ws.write(new.unionByName(self.state.where("tid is null")), f"state-{self.step}")
        self.ws.drop(f"state-{self.step - len(numbers)}")

    def shares(self) -> DataFrame:
        """(tid, log_mass, share)."""
        top = self.state.agg(F.max("log_mass").alias("m"))
        s = self.state.join(F.broadcast(top)).withColumn("e", F.exp(F.col("log_mass") - F.col("m")))
        whole = s.agg(F.sum("e").alias("w"))
        return s.join(F.broadcast(whole)).select("tid", "log_mass", (F.col("e") / F.col("w")).alias("share"))

    def follow(self, stream: DataFrame, checkpoint: str, batch: str | None = None) -> StreamingQuery:
        """Update from every micro-batch of a stream of hits. Batches are applied in order, each once per run. A micro-batch is a batch,
        or, with a column ``batch``, all batches from the first one that has not come to the last one in it."""
        following = [0]

        def each(df: DataFrame, _: int) -> None:
            if batch is None:
                self.update(df)
                return
            last = df.agg(F.max(batch)).first()[0]
            if last is not None and last >= following[0]:
                self.update_in_order(df, batch, range(following[0], last + 1))
                following[0] = last + 1

        return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _in_order(arrow, weights: dict[int, float]):
    """State rows (batch null; tid, log mass, length), then hits by batch (read_id, tid, log_p): the state after all batches, by Arrow batches."""
    import pyarrow as pa

    state, model, held = [], None, []

    def opened():
        tid, mass, length = (np.concatenate([s[i] for s in state]) if state else np.zeros(0, t) for i, t in enumerate((np.int64, float, float)))
        order = np.argsort(tid)
        return tid[order], mass[order], length[order], np.log(length[order])

    def apply(parts):
        number, read, tid, log_p = (np.concatenate(x) if len(x) > 1 else x[0] for x in zip(*parts))
        tids, mass, _, log_length = model
        at = np.minimum(np.searchsorted(tids, tid), max(len(tids) - 1, 0))
        known = tids[at] == tid if len(tids) else np.zeros(len(tid), bool)
        if number[0] not in weights or not known.any():
            return
        read, at, log_p = read[known], at[known], log_p[known]
        order = np.lexsort((-log_p, at, read))  # the most probable of repeated hits comes first
        read, at, log_p = read[order], at[order], log_p[order]
        first = np.ones(len(read), bool)
        first[1:] = (read[1:] != read[:-1]) | (at[1:] != at[:-1])
        read, at, log_p = read[first], at[first], log_p[first]
        begins = np.flatnonzero(np.r_[True, read[1:] != read[:-1]])
        sizes = np.diff(np.r_[begins, len(read)])
        lg = mass[at] - log_length[at] + log_p
        most = np.maximum.reduceat(lg, begins)
        norm = most + np.log(np.add.reduceat(np.exp(lg - np.repeat(most, sizes)), begins))
        touched, which = np.unique(at, return_inverse=True)
        with np.errstate(divide="ignore"):  # the logarithm of zero adds nothing
            got = np.log(np.bincount(which, np.exp(lg - np.repeat(norm, sizes))))
        mass[touched] = np.logaddexp(mass[touched], got + weights[number[0]])

    for b in arrow:
        if model is None:
            is_state = b.column(0).is_null().to_numpy(zero_copy_only=False)
            n = int(is_state.sum())  # they come first
            if n:
                state.append([b.column(i).slice(0, n).to_numpy() for i in (2, 3, 4)])
            b = b.slice(n)
            if not b.num_rows:
                continue
            model = opened()
        x = [b.column(i).to_numpy() for i in range(4)]
        cuts = [0, *(np.flatnonzero(x[0][1:] != x[0][:-1]) + 1).tolist(), len(x[0])]
        for lo, hi in zip(cuts, cuts[1:]):
            if held and held[0][0][0] != x[0][lo]:
                apply(held)
                held = []
            held.append([c[lo:hi] for c in x])
    model = opened() if model is None else model
    if held:
        apply(held)
    for i in range(0, len(model[0]), 100_000):
        j = slice(i, i + 100_000)
        yield pa.RecordBatch.from_arrays([pa.array(model[0][j]), pa.array(model[2][j]), pa.array(model[1][j])], ["tid", "length", "log_mass"])


def passes(model: OnlineAbundance, hits: DataFrame, batch: str, numbers: Iterable[int], required: int, most: int = 10) -> int:
    """Go over the batches again until ``required`` reads were seen, at most ``most`` times; returns the reads seen."""
    numbers, seen = list(numbers), 0
    once = hits.where(F.col(batch).between(numbers[0], numbers[-1])).select(batch, "read_id").distinct().count()
    for _ in range(most):
        model.update_in_order(hits, batch, numbers)
        seen += once
        if seen >= required or not seen:
            break
    return seen
