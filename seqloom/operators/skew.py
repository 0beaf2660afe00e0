"""Per-key results when a handful of keys hold most of the rows.

The states used (counts, sums, minima, maxima) are algebraic, so Spark combines them in a bounded hash table
of each map task, spills that table when it is full, and shuffles one partial state per key and task.  A key
with a third of all rows therefore costs each reducer one small row per map task.  Distinct values of a second
column are counted in two such levels, (key, value) and then key, so that the values of a hot key spread over
all reducers; nothing is ever collected per key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def per_key(
    df: DataFrame,
    key: str,
    distinct: str | None = None,
    sums: dict[str, Column] | None = None,
) -> DataFrame:
    """One row per key: ``n_rows``, the named sums and, if asked for, ``n_distinct`` values of a column.

    Null keys form one group with a null key.  Nulls in ``distinct`` are no value.  Rows delivered twice
    count twice.  An empty table gives no rows.  Other columns of ``df`` are not read.
    """
    sums = sums or {}
    reserved = {"n_rows", "n_distinct", "__value"} & ({key} | set(sums))
    if reserved:
        raise ValueError(f"reserved names: {sorted(reserved)}")
    if distinct is None:
        return df.groupBy(F.col(key)).agg(F.count(F.lit(1)).alias("n_rows"), *(F.sum(c).alias(n) for n, c in sums.items()))
    first = df.groupBy(F.col(key), F.col(distinct).alias("__value")).agg(
        F.count(F.lit(1)).alias("n_rows"), *(F.sum(c).alias(n) for n, c in sums.items())
    )
    return first.groupBy(key).agg(
        F.sum("n_rows").alias("n_rows"), *(F.sum(n).alias(n) for n in sums), F.count("__value").alias("n_distinct")
    )


def dominating(counts: DataFrame, key: str, share: float, whole: DataFrame | None = None) -> DataFrame:
    """Keys that hold at least ``share`` of all rows, with ``n_rows`` and the ``share`` they hold.

    ``counts`` is the result of :func:`per_key` with every key in it, also null ones, as all rows make up the
    total. ``whole``, one row with the total in its only column, saves adding up the counts, which would make them
    twice. Null keys are never named. There are at most 1 / share such keys.
    """
    if not 0 < share <= 1:
        raise ValueError("share must be above 0 and at most 1")
    whole = counts.agg(F.sum("n_rows").alias("__total")) if whole is None else whole.toDF("__total")
    # the total is one row, so this is no cross join of two tables
    return (
        counts.join(F.broadcast(whole))
        .where(F.col(key).isNotNull() & (F.col("n_rows") >= F.lit(share) * F.col("__total")))
        .select(key, "n_rows", (F.col("n_rows") / F.col("__total")).alias("share"))
    )
