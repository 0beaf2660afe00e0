"""Count databases: tables (kmer packed, cnt) on disk with their parameters, and set operations on them."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kmers as K


def save(counts: DataFrame, path: str, k: int, ci: int, cx: int, cs: int) -> None:
    """Write a database: counts sorted by k-mer within range-partitioned files, so that the statistics of a file or
    row group rule it out for a k-mer outside its range; and one row of parameters."""
    spark = counts.sparkSession
    counts.repartitionByRange("kmer").sortWithinPartitions("kmer").write.mode("overwrite").parquet(f"{path}/counts")
    spark.createDataFrame([(json.dumps({"k": k, "ci": ci, "cx": cx, "cs": cs}),)], "parameters string").write.mode("overwrite").parquet(f"{path}/parameters")


class KmerDb:
    """A saved database. Thresholds can be narrowed, not widened, and reset."""

    def __init__(self, spark: SparkSession, path: str):
        self.counts = spark.read.parquet(f"{path}/counts")
        p = json.loads(spark.read.parquet(f"{path}/parameters").first()[0])
        self.k, self._own = p["k"], (p["ci"], min(p["cx"], 2**62))
        self.least, self.most = self._own

    def narrow(self, least: int | None = None, most: int | None = None) -> bool:
        """Raise the least or lower the most count; False, and no change, if that would widen or cross the limits."""
        lo, hi = self.least if least is None else least, self.most if most is None else most
        if not (self._own[0] <= lo <= hi <= self._own[1]):
            return False
        self.least, self.most = lo, hi
        return True

    def reset(self) -> None:
        self.least, self.most = self._own

    def listing(self) -> DataFrame:
        return self.counts.where(F.col("cnt").between(self.least, self.most))

    def count(self) -> DataFrame:
        return self.listing().agg(F.count(F.lit(1)).alias("n"))


def look_up(queries: DataFrame, db: DataFrame, key: str) -> DataFrame:
    """Queries with cnt (0 if unknown) and found. The database has one row a key, so no query is multiplied."""
    found = queries.join(db.withColumnRenamed("cnt", "__cnt"), key, "left")
    return found.select(*queries.columns, F.coalesce("__cnt", F.lit(0)).alias("cnt"), F.col("__cnt").isNotNull().alias("found"))


def merge(dbs: list[DataFrame], least: int = 1, most: int | None = None) -> DataFrame:
    """Sum of the counts of several databases, filtered after summing."""
    out = reduce(DataFrame.unionByName, (x.select("kmer", "cnt") for x in dbs)).groupBy("kmer").agg(F.sum("cnt").alias("cnt"))
    return out.where((F.col("cnt") >= least) & (F.lit(True) if most is None else F.col("cnt") <= most))


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.withColumnRenamed("cnt", "cnt_a").join(b.withColumnRenamed("cnt", "cnt_b"), "kmer").select("kmer", "cnt_a", "cnt_b")


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """(kmer, side): in one aggregation of both, without a join."""
    both = a.select("kmer", F.lit("a").alias("side")).unionByName(b.select("kmer", F.lit("b").alias("side"))).groupBy("kmer").agg(F.min("side").alias("side"), F.max("side").alias("last"))
    return both.where("side = last").select("kmer", "side")


def count_only(keys: DataFrame, counts: DataFrame) -> DataFrame:
    """Counts of the given k-mers, 0 for those that do not occur."""
    return keys.select("kmer").distinct().join(counts, "kmer", "left").select("kmer", F.coalesce("cnt", F.lit(0)).alias("cnt"))


def bloom_filtered(reads: DataFrame, seq: str, k: int, least: int = 2) -> DataFrame:
    """k-mers that occur at least ``least`` times. The count itself is exact; the first pass of a Bloom counter only
    saves memory for singletons, which the map-side combined count does not hold either, so no filter is built."""
    return K.count_kmers(reads, seq, k).where(F.col("cnt") >= least)


def least_above(a: Column | str, b: Column | str, bucket: int) -> Column:
    """The lesser of two numbers that is above ``bucket``, else the greater if that is, else -1."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    low, high = F.least(a, b), F.greatest(a, b)
    return F.when(low > bucket, low).when(high > bucket, high).otherwise(F.lit(-1).cast("long"))


def dump(counts: DataFrame, kmer: str, value: str) -> DataFrame:
    """(line): k-mer, tab, count; a count that is no whole number with six significant digits."""
    kind = counts.schema[value].dataType.simpleString()
    text = F.format_string("%.6g", F.col(value)) if kind in ("double", "float") else F.col(value).cast("string")
    return counts.select(F.concat(F.col(kmer), F.lit("\t"), text).alias("line"))
