"""Making and changing sequences for experiments."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def mutate(seq: Column, where: Callable[[Column], Column]) -> Column:
    """Replace the base at each position p (from 1) for which ``where(p)`` holds by the next one of A, C, G, T."""
    at = lambda p: F.substring(seq, p, F.lit(1))
    changed = F.transform(F.sequence(F.lit(1), F.length(seq)), lambda p: F.when(where(p), F.translate(at(p), "ACGT", "CGTA")).otherwise(at(p)))
    return F.when(F.length(seq) > 0, F.array_join(changed, "")).otherwise(seq)


def mutation_rate(a: Column, b: Column) -> Column:
    """Share of positions of the shorter sequence in which two sequences differ; null for an empty one."""
    n = F.least(F.length(a), F.length(b))
    same = lambda p: F.substring(a, p, F.lit(1)) != F.substring(b, p, F.lit(1))
    return F.when(n > 0, F.size(F.filter(F.sequence(F.lit(1), n), same)) / n)


def random_sequences(spark: SparkSession, n: int, length: int, seed: int = 0) -> DataFrame:
    """(read_id, seq): random sequences; the same seed gives the same ones, however the rows are partitioned."""
    base = lambda i: F.substring(F.lit("ACGT"), (F.xxhash64(F.lit(seed), "id", i).bitwiseAND(F.lit(3)) + 1).cast("int"), F.lit(1))
    return spark.range(n).select(F.col("id").alias("read_id"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(length)), base), "").alias("seq"))
