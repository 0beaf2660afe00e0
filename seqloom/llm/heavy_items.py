"""Most frequent items in bounded memory: Misra-Gries summaries, merged in a tree.

A summary has at most ``k`` counters and the sum ``lost`` of what was subtracted from them.  Batches of rows are counted
exactly and added; when there are too many counters, the (k + 1)-th largest count is subtracted from all and what is not
positive is dropped.  Summaries are merged in the same way.  For an item with true count f the summary holds a count c with
c <= f <= c + lost, and lost <= N / (k + 1): every item above that is in it.  Counters are columns, added up and cut by
array operations.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.workspace import Workspace

_SCHEMA = "node int, item string, n long, lost long, total long"


def shrink(items: pa.Array, n: np.ndarray, k: int) -> tuple[pa.Array, np.ndarray, int]:
    """At most k counters of distinct items, and what was subtracted from each."""
    if len(n) <= k:
        return items, n, 0
    cut = int(np.partition(n, len(n) - k - 1)[len(n) - k - 1])
    keep = np.flatnonzero(n > cut)
    return items.take(pa.array(keep)), n[keep] - cut, cut


class _Summary:
    """Counters that are added up and shrunk once eight times k of them have come together: larger steps lose no more."""

    def __init__(self, k: int):
        self.k, self.lost, self.total, self.pieces, self.size = k, 0, 0, [], 0

    def add(self, items: pa.Array, n: pa.Array) -> None:
        self.pieces.append(pa.table([items.cast(pa.string()), n], ["item", "n"]))
        self.size += len(items)
        if self.size > 8 * self.k:
            self.settle()

    def settle(self) -> tuple[pa.Array, np.ndarray]:
        if not self.pieces:
            return pa.array([], pa.string()), np.zeros(0, np.int64)
        t = pa.concat_tables(self.pieces).group_by("item").aggregate([("n", "sum")])
        items, n, cut = shrink(t["item"].combine_chunks(), t["n_sum"].to_numpy(), self.k)
        self.lost += cut
        self.pieces, self.size = [pa.table([items, pa.array(n)], ["item", "n"])], len(items)
        return items, n

    def rows(self, node: int) -> pa.RecordBatch:
        items, n = self.settle()
        if not len(items):  # a summary without counters still has a row, for lost and total
            items, n = pa.nulls(1, pa.string()), np.zeros(1, np.int64)
        whole = lambda x, kind: pa.array(np.full(len(n), x, kind))
        return pa.RecordBatch.from_arrays([whole(node, np.int32), items, pa.array(n), whole(self.lost, np.int64), whole(self.total, np.int64)], ["node", "item", "n", "lost", "total"])


def _summarise(k: int):
    def run(batches):
        s = _Summary(k)
        for b in batches:
            values = pc.value_counts(b.column(0).drop_null())
            s.add(values.field(0), values.field(1))
            s.total += b.num_rows - b.column(0).null_count
        yield s.rows(TaskContext.get().partitionId())

    return run


def _merged(k: int):
    def run(key, table):
        s = _Summary(k)
        _, first = np.unique(table["node"].to_numpy(), return_index=True)
        for c in ("lost", "total"):  # of each summary once
            setattr(s, c, int(table[c].to_numpy()[first].sum()))
        t = table.filter(pc.is_valid(table["item"]))
        for b in t.select(["item", "n"]).to_batches():
            s.add(b.column(0), b.column(1))
        return pa.Table.from_batches([s.rows(key[0].as_py())])

    return run


def summary(df: DataFrame, column: str, k: int, fans: tuple[int, ...] = (4096, 256, 16)) -> DataFrame:
    """(item as text, n, lost, total) of one summary over all rows: at most k rows, or one with a null item.

    Nulls are no items. Partition summaries meet in groups of ``fans`` nodes, level by level as far as there are more
    partitions than that, so no task reads more than some sixteen of them.
    """
    part = df.select(column).mapInArrow(_summarise(k), _SCHEMA)
    partitions = df._jdf.queryExecution().toRdd().getNumPartitions()
    for fan in [f for f in fans if f < partitions] + [1]:
        # the summaries of a node keep their own node number, so that lost and total of each count once
        part = part.withColumn("to", F.col("node") % fan).groupBy("to").applyInArrow(_merged(k), _SCHEMA)
    return part.select("item", "n", "lost", "total")


def most_frequent(df: DataFrame, column: str, top: int, k: int = 1024, max_k: int = 1 << 17) -> DataFrame:
    """The ``top`` most frequent items: item (text), n_rows (exact), n_summary and error_bound of the summary, guaranteed.

    The candidates of the summary, at most k of them, are counted exactly in a second pass. If the last of the
    ``top`` is not above what any item outside the summary can have, the summary is taken again with four times as
    many counters, up to ``max_k``, which bounds the memory (some 100 MB a merge). ``guaranteed``: no item that is not listed
    has more rows. Where frequencies are so even that max_k counters cannot tell, it is false, and fewer than ``top`` items may
    be left; the bound then says how many rows an item may have and not be listed. Ties with the last one are broken by the
    text of the item.  Null items are ignored; an empty table gives no rows; fewer distinct items give fewer rows.
    """
    spark = df.sparkSession
    items = Workspace(spark, "items").write(df.select(F.col(column).alias("item")), "items")  # read twice or more, made once
    while True:
        s = summary(items, "item", k).collect()  # at most k rows
        if not s or s[0].total == 0:
            return spark.createDataFrame([], "item string, n_rows long, n_summary long, error_bound long, guaranteed boolean")
        lost = s[0].lost
        candidates = spark.createDataFrame([(r.item, r.n) for r in s if r.item is not None], "item string, n_summary long")
        exact = (
            items.select(F.col("item").cast("string").alias("item"))
            .join(F.broadcast(candidates), "item")  # at most k rows
            .groupBy("item", "n_summary")
            .agg(F.count(F.lit(1)).alias("n_rows"))
        )
        best = exact.orderBy(F.desc("n_rows"), "item").limit(top).collect()  # ``top`` rows
        # everything was kept (nothing lost), or the last candidate beats whatever was lost
        if lost == 0 or (len(best) == top and best[-1].n_rows > lost) or k >= max_k:
            rows = [(r.item, r.n_rows, r.n_summary, lost, r.n_rows > lost) for r in best]
            return spark.createDataFrame(rows, "item string, n_rows long, n_summary long, error_bound long, guaranteed boolean")
        k *= 4
