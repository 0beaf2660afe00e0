"""Queries of the training-data operators over the tables of the sequence domain and the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sequence import is_id, read_key
from ..plans.workspace import Workspace, table
from . import sql
from .components import connected_components, star_edges
from .garbled import garbled_documents, restore
from .heavy_items import most_frequent
from .mixing import mix
from .seen_keys import SeenKeys, batches
from .shared_spans import shared_spans
from .term_counts import TermCounts, spell
from .tokenizer import encode, measure

# -- 1. has this key been seen before?


def _seen_reads(spark: SparkSession, d: str, n_batches: int = 4) -> SeenKeys:
    reads = table(spark, d, "read_seqs").select("read_id", read_key("seq").alias("read_key"))
    store = SeenKeys(spark)
    for b in batches(reads, "read_id", n_batches):
        store.ingest(b, "read_key", "read_id", answer=True)
    return store


def _seen_classes(spark: SparkSession, d: str, n_batches: int = 4) -> SeenKeys:
    hits = table(spark, d, "kmer_hits").select("hit_id", "kmer_id", "loaded_at")
    store = SeenKeys(spark)
    for b in batches(hits, "hit_id", n_batches):
        store.ingest(b.where(is_id("kmer_id")), "kmer_id", "loaded_at")
    return store


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    questions = table(spark, d, "kmer_queries").where(is_id("kmer_id"))
    a = _seen_reads(spark, d).repeats().select(F.lit("read_seqs.seq").alias("field"), F.col("ord").alias("rec_id"))
    b = _seen_classes(spark, d).probe(questions, "kmer_id", "asked_at").select(F.lit("kmer_queries.kmer_id").alias("field"), F.col("query_id").alias("rec_id"))
    return a.unionByName(b)


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    """Per field: distinct keys stored, and wrong answers of the hash alone at the first rows of keys (verified hits have none)."""
    one = _seen_reads(spark, d).report().select(F.lit("read_seqs.seq").alias("field"), "*")
    two = _seen_classes(spark, d).report().select(F.lit("kmer_queries.kmer_id").alias("field"), "*")
    return one.unionByName(two).withColumn("wrong_rate", F.when(F.col("n_keys") > 0, F.col("n_false_hits") / F.col("n_keys")).otherwise(F.lit(0.0)))


# -- 2. frequency of every distinct term


def _params(spark: SparkSession, d: str) -> DataFrame:
    """The counter parameters (a fixed table of a few rows) with a group number."""
    p = table(spark, d, "count_params").where("lib_code is not null and p_k is not null")
    return p.groupBy("lib_code").agg(
        F.max("p_k").alias("p_k"), F.coalesce(F.max("p_ci"), F.lit(2)).alias("ci"), F.coalesce(F.max("p_cx"), F.lit(1000000000)).alias("cx")
    )


class _Reads:
    """Counts over the reads of the libraries in count_params."""

    def __init__(self, spark: SparkSession, d: str):
        rows = _params(spark, d).orderBy("lib_code").collect()  # parameters, one row a library
        self.ks = {i: r.p_k for i, r in enumerate(rows)}
        self.params = spark.createDataFrame([(i, r.lib_code, r.ci, r.cx) for i, r in enumerate(rows)], "grp int, lib_code string, ci int, cx int")
        groups = F.broadcast(self.params.select("grp", "lib_code"))
        self.reads = table(spark, d, "read_seqs").join(groups, "lib_code").select("grp", "seq", "run_at", "loaded_at", F.lit(1).alias("sign"))
        self.n_bases = self.reads.agg(F.coalesce(F.sum(F.length("seq")), F.lit(0))).first()[0]
        self.store = TermCounts(spark, self.ks)

    def marked(self) -> DataFrame:
        rare, common = F.col("n_rec") < F.col("ci"), F.col("n_occ") > F.col("cx")
        return self.store.counts().join(F.broadcast(self.params), "grp").withColumn("mark", F.when(rare, "rare").when(common, "common"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    r = _Reads(spark, d)
    r.store.apply(r.reads, r.n_bases)
    found = r.marked().where("mark is not null")
    return spell(found, r.ks, "lib_code string, mark string").select("lib_code", "kmer", "mark")


def _all_counts(r: _Reads) -> DataFrame:
    return spell(r.marked(), r.ks, "lib_code string, n_occ long, n_rec long, mark string").select("lib_code", "kmer", "n_occ", F.col("n_rec").alias("n_reads"), "mark")


def p2_counts(spark: SparkSession, d: str) -> DataFrame:
    """Occurrences, reads and mark of every k-mer of every library in count_params."""
    r = _Reads(spark, d)
    r.store.apply(r.reads, r.n_bases)
    return _all_counts(r)


def p2_update(spark: SparkSession, d: str) -> DataFrame:
    """The same counts, reached by deltas: the reads loaded within a day of their run, a wrong correction of these
    (all sequences replaced by their first half), its withdrawal, and the reads loaded late."""
    r = _Reads(spark, d)
    late = F.coalesce(F.col("loaded_at") > F.col("run_at") + F.expr("interval 1 day"), F.lit(False))
    early = r.reads.where(~late)
    half = early.withColumn("seq", F.expr("substring(seq, 1, length(seq) div 2)"))
    minus = lambda df: df.withColumn("sign", F.lit(-1))
    r.store.apply(early, r.n_bases)
    r.store.apply(minus(early).unionByName(half), r.n_bases)
    r.store.apply(minus(half).unionByName(early).unionByName(r.reads.where(late)), r.n_bases)
    return _all_counts(r)


# -- 5. most frequent items


def p5_bounds(spark: SparkSession, d: str) -> DataFrame:
    """The ten most frequent keys per field: exact rows, the count of the summary and its error bound, and whether no other key can have more."""
    reads = table(spark, d, "read_seqs").select(read_key("seq").alias("item"))
    hits = table(spark, d, "kmer_hits").where(is_id("kmer_id")).select(F.col("kmer_id").alias("item"))
    a = most_frequent(reads, "item", 10).withColumn("field", F.lit("read_seqs.seq"))
    b = most_frequent(hits, "item", 10).withColumn("field", F.lit("kmer_hits.kmer_id"))
    return a.unionByName(b).withColumnRenamed("item", "item_key")


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    """The same without what depends on the partitions: the exact rows of each key."""
    return p5_bounds(spark, d).select("field", "item_key", "n_rows", "guaranteed")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_bounds(spark, d).select("field", "item_key")


# -- 6. consolidating pairwise matches into groups


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    ws = Workspace(spark, "matches")
    skip = table(spark, d, "promiscuous_classes").where("kmer_id is not null").select("kmer_id").distinct()  # a fixed list
    hits = table(spark, d, "kmer_hits").where(is_id("kmer_id")).select("kmer_id", "transcript_id").join(skip, "kmer_id", "left_anti")
    genes = table(spark, d, "transcripts").where("gene_id <> 0").select("gene_id", "transcript_id")
    edges = star_edges(hits, "kmer_id", "transcript_id", ws, "classes").unionByName(star_edges(genes, "gene_id", "transcript_id", ws, "genes"))
    return connected_components(edges, "u", "v").select(F.col("node").alias("transcript_id"), F.col("component").alias("group_id"))


# -- 7. long exact spans shared between records


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "transcripts").select("transcript_id", "kmers")
    return shared_spans(t, "transcript_id", "kmers", 32).withColumnRenamed("rec", "transcript_id")


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    """Per transcript: shared positions, their share of kmers, and that share of its length."""
    t = table(spark, d, "transcripts").where("transcript_id is not null")
    sizes = t.groupBy("transcript_id").agg(F.max(F.coalesce(F.size("kmers"), F.lit(0))).cast("long").alias("n_kmers"), F.max("length").alias("length"))
    spans = p7_found(spark, d).groupBy("transcript_id").agg(F.sum(F.col("span_end") - F.col("span_start") + 1).alias("n_shared"), F.count(F.lit(1)).alias("n_spans"))
    share = F.when(F.col("n_kmers") > 0, F.round(F.coalesce("n_shared", F.lit(0)) / F.col("n_kmers"), 6)).otherwise(F.lit(0.0))
    return sizes.join(spans, "transcript_id", "left").select(
        "transcript_id",
        "n_kmers",
        F.coalesce("n_spans", F.lit(0)).alias("n_spans"),
        F.coalesce("n_shared", F.lit(0)).alias("n_shared"),
        share.alias("shared_share"),
        F.round(share * F.col("length"), 2).alias("shared_length"),
    )


# -- 8. encoding of the corpus


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode(table(spark, d, "documents"), "doc_id", "text")


# -- 9. mixing sources


def _mixed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, d, "documents").where("source is not null")
    sized = Workspace(spark, "mix").write(measure(docs, ["doc_id", "source"], "text"), "sized")
    return mix(sized, table(spark, d, "source_weights"), "doc_id", "source", "n_tokens", "diversity")


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    """The documents of a mix of as many tokens as those of the listed sources, with the number of times each is used."""
    return _mixed(spark, d)[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """Per listed source: its target share, what it had, what it was to give and gave, what it fell short by, and the share reached."""
    return _mixed(spark, d)[1]


# -- 10. garbled text from wrong character encoding


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return garbled_documents(table(spark, d, "documents"), "doc_id", "text")


def p10_restored(spark: SparkSession, d: str) -> DataFrame:
    """The garbled documents with their text restored as far as possible."""
    return restore(table(spark, d, "documents"), "doc_id", "text")


QUERIES = {
    name: f
    for name, f in globals().items()
    if name[0] == "p" and name[1].isdigit() and callable(f)
}
ORACLE = sql.ORACLE
