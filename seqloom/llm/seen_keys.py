"""Has this key been seen before?  A log-structured store of keys in sorted, immutable runs.

A batch is reduced to one row per key (hash, key, earliest ord) and flushed as a table bucketed by (hash, key) and sorted
within each bucket, one file a bucket.  Before it becomes a run it is probed against the runs by a merge join on hash and
full key: both sides lie bucketed and sorted on disk, so nothing of a run is shuffled or sorted again.  The probe answers
the batch: a key with a stored ord has been seen, and so has every row of the batch but the earliest of its key.  What
becomes a run are the keys with no stored ord as early.

Fences: the hashes are cut into 4096 blocks of equal width.  If a batch touches few blocks, the probe reads only these:
the ranges are pushed down to the scan, where the row groups and pages of the sorted files are skipped by their
statistics.  When a level has ``fanout`` runs, they are merged in pairs by full merge joins, again without a shuffle,
into one run of the next level.

The hash only finds candidates; equality of the full key decides.  ``report`` tells how often an answer by the hash alone
would have been wrong.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..plans.workspace import Workspace, private_session

_BY = ["h", "key"]
_FENCE_BITS = 12
#: Ranges of a filter: more would skip little more, and take longer to plan.
_MOST_RANGES = 32


class SeenKeys:
    """Earliest ``ord`` (any type with an order) of every key.

    Null keys are no keys: they are neither stored nor ever seen, nor are rows with a null ord. Repeated rows count as
    rows. A batch without rows changes nothing. Batches may come in any order; the earliest ord of a key counts, and a row
    that was answered as the first is reported as a repeat by the later batch that brings an earlier one.

    ``path``: folder to keep the store in; a store that lies there is opened. After each batch the list of runs is written
    to it under a new name, and only then are the runs it replaces removed, so a batch that fails leaves the store as it
    was. A batch with a ``batch_id`` that the store has is not taken again, so a retry is harmless.
    """

    def __init__(self, spark: SparkSession, fanout: int = 3, hash_bits: int = 64, buckets: int | None = None, path: str | None = None):
        if fanout < 2 or not 1 <= hash_bits <= 64:
            raise ValueError("fanout must be 2 or more, hash_bits from 1 to 64")
        self.spark = spark
        # merge joins of sorted buckets, whatever the settings of the caller, which stay as they are
        self.own = private_session(spark, **{"spark.sql.legacy.bucketedTableScan.outputOrdering": "true", "spark.sql.autoBroadcastJoinThreshold": "-1"})
        self.ws = Workspace(spark, "seen", path)
        self.state = self.ws.noted() or {
            "fanout": fanout, "hash_bits": hash_bits, "buckets": buckets or int(spark.conf.get("spark.sql.shuffle.partitions")),
            "types": None, "levels": [[]], "answers": [], "taken": [],
        }

    # -- tables

    @property
    def levels(self) -> list[list[str]]:
        return self.state["levels"]

    @property
    def runs(self) -> list[str]:
        return [n for level in self.levels for n in level]

    @property
    def hash_bits(self) -> int:
        return self.state["hash_bits"]

    def _hash(self, key: Column) -> Column:
        h = F.xxhash64(key)
        return h if self.hash_bits == 64 else h.bitwiseAND(F.lit((1 << self.hash_bits) - 1))

    def _schema(self) -> StructType:
        return StructType.fromDDL("h long, key {}, ord {}".format(*self.state["types"]))

    def _table(self, name: str) -> DataFrame:
        return self.ws.read_bucketed(name, self._schema(), self.state["buckets"], _BY, session=self.own)

    def _files(self, name: str, column: str) -> DataFrame:
        """One column of a run, in the caller's session; ``stored`` is null in a run that has no such column."""
        return self.spark.read.schema(f"{column} {self.state['types'][1]}").parquet(self.ws.where(name))

    def _save(self, df: DataFrame) -> str:
        """Write one row a key, bucketed and sorted; ``df`` is partitioned by bucket already, so each is one file."""
        name = f"run-{uuid.uuid4().hex}"
        self.ws.write_bucketed(df, name, self.state["buckets"], _BY)
        return name

    def _flush(self, df: DataFrame, key: Column, ord: Column) -> str:  # noqa: A002
        """Partial aggregation leaves one row per key and map task, so a hot key costs next to nothing."""
        new = df.groupBy(self._hash(key).alias("h"), key.alias("key")).agg(F.min(ord).alias("ord"))
        if self.state["types"] is None:
            self.state["types"] = [new.schema[c].dataType.simpleString() for c in ("key", "ord")]
        if int(self.spark.conf.get("spark.sql.shuffle.partitions")) != self.state["buckets"]:
            new = new.repartition(self.state["buckets"], *_BY)
        return self._save(new)

    def _fences(self, flushed: DataFrame) -> list[tuple[int, int]] | None:
        """Ranges of the hashes that the flushed keys lie in, at most _MOST_RANGES, joined across the smallest gaps; None if the
        keys are so many that nearly every block is touched."""
        shift = max(0, self.hash_bits - _FENCE_BITS)
        if flushed.count() > 4 << _FENCE_BITS:  # a count of the footers
            return None
        blocks = sorted(r.b for r in flushed.select(F.shiftright("h", shift).alias("b")).distinct().collect())  # at most 4096
        if not blocks:
            return []
        gaps = sorted(range(1, len(blocks)), key=lambda i: blocks[i - 1] - blocks[i])[: _MOST_RANGES - 1]
        cuts = [0, *sorted(i for i in gaps if blocks[i] - blocks[i - 1] > 1), len(blocks)]
        return [(blocks[i] << shift, (blocks[j - 1] + 1 << shift) - 1) for i, j in zip(cuts, cuts[1:])]

    def _run(self, name: str, fences: list[tuple[int, int]] | None) -> DataFrame:
        run = self._table(name)
        if fences is None:
            return run

        def within(part):  # a balanced tree of conditions
            if len(part) == 1:
                return F.col("h").between(*part[0])
            return within(part[: len(part) // 2]) | within(part[len(part) // 2 :])

        return run.where(within(fences)) if fences else run.limit(0)

    def probed(self, flushed: str) -> DataFrame:
        """The flushed keys with ``stored``, their earliest ord in the runs, null for a key that no run holds."""
        keys, stored = self._table(flushed), []
        fences = self._fences(keys) if self.runs else None
        for i, name in enumerate(self.runs):
            r = self._run(name, fences).select("h", "key", F.col("ord").alias(f"stored_{i}"))
            keys = keys.hint("merge").join(r, _BY, "left")
            stored.append(F.col(f"stored_{i}"))
        first = F.least(*stored) if len(stored) > 1 else stored[0] if stored else F.lit(None).cast(self.state["types"][1])
        return keys.select("h", "key", "ord", first.alias("stored"))

    # -- batches

    def ingest(self, batch: DataFrame, key: str, ord: str, batch_id: str | None = None, answer: bool = False) -> None:  # noqa: A002
        """Probe a batch against the runs and append it; with ``answer`` also keep which of its rows are repeats, see :meth:`repeats`."""
        if batch_id is not None and batch_id in self.state["taken"]:
            return
        rows = batch.where(F.col(key).isNotNull() & F.col(ord).isNotNull())
        flushed = run = self._flush(rows, F.col(key), F.col(ord))
        if self.runs:
            run = self._save(self.probed(flushed).where("stored is null or stored > ord"))
        state = {**self.state, "levels": [[*self.levels[0], run], *self.levels[1:]]}
        if answer:
            name = f"answers-{uuid.uuid4().hex}"
            # the probe decides, by key, which rows are first; rows are told from these by their unique ord, which has no hot values
            seen = rows.select(F.col(ord).alias("ord")).join(self._files(run, "ord"), "ord", "left_anti")
            self.ws.write(seen.unionByName(self._files(run, "stored").where("stored is not null").toDF("ord")), name)
            state["answers"] = [*self.state["answers"], name]
        if batch_id is not None:
            state["taken"] = [*self.state["taken"], batch_id]
        gone, level = [flushed] if flushed != run else [], 0
        while level < len(state["levels"]):
            if len(state["levels"][level]) >= self.state["fanout"]:
                merged, replaced = self._merge(state["levels"][level])
                above = state["levels"][level + 1] if level + 1 < len(state["levels"]) else []
                state["levels"] = [*state["levels"][:level], [], [*above, merged], *state["levels"][level + 2 :]]
                gone += replaced
            level += 1
        self._note(state, gone)

    def _merge(self, names: list[str]) -> tuple[str, list[str]]:
        """Merge runs in pairs into one; returns it and what it replaces."""
        queue, gone = list(names), []
        while len(queue) > 1:
            a, b = (self._table(n) for n in queue[:2])
            both = a.hint("merge").join(b.withColumnRenamed("ord", "other"), _BY, "full")
            gone += queue[:2]
            queue = [*queue[2:], self._save(both.select("h", "key", F.least("ord", "other").alias("ord")))]
        return queue[0], gone

    def _note(self, state: dict, gone: list[str]) -> None:
        self.ws.note(state)
        self.state = state
        for n in gone:
            self.ws.drop(n)

    def compact(self) -> None:
        """Merge all runs into one."""
        if len(self.runs) > 1:
            merged, gone = self._merge(self.runs)
            self._note({**self.state, "levels": [*([] for _ in self.levels[1:]), [merged]]}, gone)

    # -- answers

    def repeats(self) -> DataFrame:
        """(ord) of the rows, of batches taken with ``answer``, whose key has an earlier row in any batch; ``ord`` must be unique
        over all rows. Each is in it once."""
        kind = self.state["types"][1] if self.state["types"] else "long"
        if not self.state["answers"]:
            return self.spark.createDataFrame([], f"ord {kind}")
        return self.spark.read.schema(f"ord {kind}").parquet(*(self.ws.where(n) for n in self.state["answers"]))

    def probe(self, questions: DataFrame, key: str, ord: str) -> DataFrame:  # noqa: A002
        """Questions whose key is stored with an ord before theirs, with all their columns.

        Each asked key is looked up once, however often it is asked, and the answers are joined to the questions; adaptive
        execution splits a key with very many questions.
        """
        if not self.runs:
            return questions.limit(0)
        kind, order = self.state["types"]
        asked = self._flush(questions.where(F.col(key).isNotNull()), F.col(key).cast(kind), F.lit(None).cast(order))
        known = self.ws.write(self.probed(asked).where("stored is not null").select("key", "stored"), f"known-{uuid.uuid4().hex}")
        self.ws.drop(asked)
        known = known.select(F.col("key").alias("__seqloom_key"), F.col("stored").alias("__seqloom_first"))
        return questions.join(known, (F.col(key) == F.col("__seqloom_key")) & (F.col("__seqloom_first") < F.col(ord))).select(*[questions[c] for c in questions.columns])

    def firsts(self) -> DataFrame:
        """(h, key, ord) of every key; at least one batch must have been taken. Compacts the store, as one run has one row a key."""
        self.compact()
        return self.spark.read.schema(self._schema()).parquet(self.ws.where(self.runs[0]))

    def report(self) -> DataFrame:
        """Keys, and keys that the hash alone would wrongly have called seen at their first row."""
        if not self.runs:
            return self.spark.createDataFrame([(0, 0)], "n_keys long, n_false_hits long")
        per_hash = self.firsts().groupBy("h").agg(F.count(F.lit(1)).alias("n"))
        return per_hash.agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("n_keys"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_false_hits")
        )


def batches(df: DataFrame, by: str, n: int) -> list[DataFrame]:
    """Split rows into at most n batches of neighbouring values of a numeric column, of about equal size."""
    cuts = df.agg(F.percentile_approx(by, [i / n for i in range(1, n)], 1000).alias("c")).first()["c"] if n > 1 else []
    cuts = sorted(set(cuts or []))
    c = F.col(by)
    if not cuts:
        return [df]
    return [df.where(c <= cuts[0]), *(df.where((c > a) & (c <= b)) for a, b in zip(cuts, cuts[1:])), df.where(c > cuts[-1])]
