"""Queries over the tables of the sequence domain that use general operators: hot keys and references."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sequence import is_id
from ..operators.references import OrphanLedger, reference_key, replay
from ..operators.skew import dominating, per_key
from .workspace import table


def _elements(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "transcripts").select("transcript_id", F.explode("kmers").alias("kmer_id"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    rows, transcripts = table(spark, d, "kmer_hits"), table(spark, d, "transcripts")
    hits = per_key(rows, "kmer_id")
    elements = per_key(_elements(spark, d), "kmer_id")
    # the totals need no shuffle of keys: a row count from the footers, and a sum of array sizes
    n_rows, n_elements = rows.agg(F.count(F.lit(1))), transcripts.agg(F.sum(F.size(F.coalesce("kmers", F.array()))))
    return (
        dominating(hits, "kmer_id", 0.01, n_rows)
        .withColumn("field", F.lit("kmer_hits.kmer_id"))
        .unionByName(dominating(elements, "kmer_id", 0.01, n_elements).withColumn("field", F.lit("transcripts.kmers")))
        .where(is_id("kmer_id"))
        .select("field", "kmer_id")
    )


def p3_keys(spark: SparkSession, d: str) -> DataFrame:
    """Rows and distinct transcripts of every id, both fields; ids that are null or -1 are left out."""
    out = None
    for field, df in (("kmer_hits.kmer_id", table(spark, d, "kmer_hits")), ("transcripts.kmers", _elements(spark, d))):
        one = per_key(df.where(is_id("kmer_id")), "kmer_id", distinct="transcript_id").select(F.lit(field).alias("field"), "kmer_id", "n_rows", F.col("n_distinct").alias("n_transcripts"))
        out = one if out is None else out.unionByName(one)
    return out


def references(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(references, parents) of the three reference fields."""
    tg, t, g = (table(spark, d, n) for n in ("transcript_genes", "transcripts", "genes"))

    def refs(df, name, column, row_id):
        return df.select(F.lit(name).alias("table_name"), F.lit(f"{name}.{column}").alias("field"), F.col(row_id).cast("long").alias("row_id"), reference_key(column).alias("key"), "loaded_at")

    def parents(df, field, column):
        # a row delivered twice is one version; two rows that differ in any of these are two
        return df.select(F.lit(field).alias("field"), F.xxhash64(F.col(column), "loaded_at", "deleted_at").alias("version"), reference_key(column).alias("key"), "loaded_at", "deleted_at")

    r = refs(tg, "transcript_genes", "transcript_id", "feature_id").unionByName(refs(tg, "transcript_genes", "gene_id", "feature_id")).unionByName(refs(t, "transcripts", "name", "transcript_id"))
    p = parents(t, "transcript_genes.transcript_id", "name").unionByName(parents(g, "transcript_genes.gene_id", "gene_id")).unionByName(parents(tg, "transcripts.name", "transcript_id"))
    return r, p


def _ledger(spark: SparkSession, d: str) -> OrphanLedger:
    return replay(OrphanLedger(spark, grace_days=7), *references(spark, d))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _ledger(spark, d).orphans().withColumn("field", F.substring_index("field", ".", -1))


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    """Orphans per table, field and month of the referring row."""
    return p4_found(spark, d).groupBy("table_name", "field", "month_key").agg(F.count(F.lit(1)).alias("n_orphans"))


QUERIES = {"p3_found": p3_found, "p3_keys": p3_keys, "p4_found": p4_found, "p4_report": p4_report}

_ORPHANS = r"""
refs AS (
  SELECT 'transcript_genes' AS table_name, 'transcript_id' AS field, feature_id AS row_id, transcript_id AS ref, loaded_at FROM transcript_genes
  UNION ALL SELECT 'transcript_genes', 'gene_id', feature_id, gene_id, loaded_at FROM transcript_genes
  UNION ALL SELECT 'transcripts', 'name', transcript_id, name, loaded_at FROM transcripts),
targets AS (
  SELECT 'transcript_id' AS field, name AS target, loaded_at, deleted_at FROM transcripts
  UNION ALL SELECT 'gene_id', gene_id, loaded_at, deleted_at FROM genes
  UNION ALL SELECT 'name', transcript_id, loaded_at, deleted_at FROM transcript_genes),
r AS (SELECT DISTINCT table_name, field, row_id, lower(regexp_replace(ref, '^\s+|\s+$', '', 'g')) AS k, loaded_at FROM refs),
t AS (SELECT DISTINCT field, lower(regexp_replace(target, '^\s+|\s+$', '', 'g')) AS k, loaded_at, deleted_at FROM targets),
orphans AS (
  SELECT DISTINCT table_name, field, row_id, strftime(loaded_at, '%Y-%m') AS month_key FROM r
  WHERE k <> '' AND NOT EXISTS (
    SELECT 1 FROM t WHERE t.field = r.field AND t.k = r.k AND t.loaded_at <= r.loaded_at + INTERVAL 7 DAY
      AND (t.deleted_at IS NULL OR t.deleted_at > r.loaded_at)))"""

ORACLE = {
    "p3_found": """
SELECT 'kmer_hits.kmer_id' AS field, kmer_id FROM kmer_hits GROUP BY kmer_id
HAVING kmer_id <> -1 AND count(*) >= 0.01 * (SELECT count(*) FROM kmer_hits)
UNION ALL
SELECT 'transcripts.kmers', k FROM (SELECT unnest(kmers) AS k FROM transcripts) GROUP BY k
HAVING k <> -1 AND count(*) >= 0.01 * (SELECT sum(len(kmers)) FROM transcripts)""",
    "p3_keys": """
SELECT 'kmer_hits.kmer_id' AS field, kmer_id, count(*) AS n_rows, count(DISTINCT transcript_id) AS n_transcripts
FROM kmer_hits WHERE kmer_id <> -1 GROUP BY kmer_id
UNION ALL
SELECT 'transcripts.kmers', k, count(*), count(DISTINCT transcript_id) FROM (SELECT transcript_id, unnest(kmers) AS k FROM transcripts)
WHERE k <> -1 GROUP BY k""",
    "p4_found": f"WITH {_ORPHANS} SELECT table_name, field, row_id, month_key FROM orphans",
    "p4_report": f"WITH {_ORPHANS} SELECT table_name, field, month_key, count(*) AS n_orphans FROM orphans GROUP BY ALL",
}
