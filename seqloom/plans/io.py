"""Queries that write the tables as text files and read them back: the rows must survive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import sequence as S
from ..functions.utilities import mutate, mutation_rate as rate
from ..operators import index as I
from ..operators import kmers as K
from ..sources import sinks, text
from ..streaming.online import stream_fasta
from . import mapping, quant
from .counting import COUNTS, k_
from .quant import TK, hits
from .registry import Registry
from .workspace import Workspace, table

query = Registry()

_SEQ = r"upper(regexp_replace(seq, '\s+', '', 'g'))"
_QUAL = "array_to_string(list_transform(generate_series(1, length(s)), lambda p: chr((33 + (read_id * 31 + p * 7) % 41)::INT)), '')"


def _named(spark, d) -> DataFrame:
    return table(spark, d, "read_seqs").where("seq is not null").select("read_id", F.col("read_id").cast("string").alias("name"), S.squeeze("seq").alias("seq")).where("seq <> ''")


def _with_quality(df: DataFrame) -> DataFrame:
    q = F.transform(F.sequence(F.lit(1), F.length("seq")), lambda p: F.char(F.lit(33) + (F.col("read_id") * 31 + p * 7) % 41))
    return df.withColumn("qual", F.array_join(q, ""))


@query(f"SELECT read_id::VARCHAR AS name, {_SEQ} AS seq FROM read_seqs WHERE {_SEQ} <> ''")
def fasta_roundtrip(spark, d):
    """#1: one line a record."""
    ws = Workspace(spark, "io")
    sinks.write_fasta(_named(spark, d), "name", "seq", ws.where("fa"))
    return text.read_fasta(spark, ws.where("fa")).select("name", "seq")


@query(f"SELECT read_id::VARCHAR AS name, {_SEQ} AS seq FROM read_seqs WHERE {_SEQ} <> ''")
def fasta_multiline_gz(spark, d):
    """#3, #4, #5, #10: lines of 60 bases, one half of the reads compressed, read through a list of paths."""
    ws, r = Workspace(spark, "io"), _named(spark, d)
    sinks.write_fasta(r.where("read_id % 2 = 0").withColumn("name", F.concat("name", F.lit(" first half"))), "name", "seq", ws.where("a"), width=60, compression="gzip")
    sinks.write_fasta(r.where("read_id % 2 = 1"), "name", "seq", ws.where("b"), width=60)
    sinks.write_lines(spark.createDataFrame([(ws.where("a"),), (ws.where("b"),)], "p string"), "p", ws.where("list"))
    return text.read_fasta(spark, text.listed_paths(spark, "@" + ws.where("list"))).select("name", "seq")


@query(f"SELECT read_id::VARCHAR AS name, s AS seq, {_QUAL} AS qual FROM (SELECT read_id, {_SEQ} AS s FROM read_seqs) WHERE s <> ''")
def fastq_roundtrip(spark, d):
    """#2: four-line records with qualities."""
    ws = Workspace(spark, "io")
    sinks.write_fastq(_with_quality(_named(spark, d)), "name", "seq", "qual", ws.where("fq"))
    return text.read_fastq(spark, ws.where("fq")).select("name", "seq", "qual")


@query(f"""WITH r AS (SELECT read_id, {_SEQ} AS s FROM read_seqs WHERE {_SEQ} <> ''), n AS (SELECT *, (row_number() OVER (PARTITION BY read_id % 2 ORDER BY read_id) - 1)::BIGINT AS ordinal FROM r)
SELECT a.ordinal, a.read_id::VARCHAR AS name, a.s AS seq1, b.s AS seq2 FROM n a JOIN n b USING (ordinal) WHERE a.read_id % 2 = 0 AND b.read_id % 2 = 1""")
def pairs_lockstep(spark, d):
    """#8: two files of mates, paired by position."""
    ws, r = Workspace(spark, "io"), _with_quality(_named(spark, d))
    for i in (0, 1):
        sinks.write_fastq(r.where(F.col("read_id") % 2 == i), "name", "seq", "qual", ws.where(f"m{i}"), order="read_id")
    return text.read_pairs(spark, ws.where("m0"), ws.where("m1")).select("ordinal", "name", "seq1", "seq2")


@query(f"WITH {COUNTS} SELECT kmer FROM counts")
def kmer_list_roundtrip(spark, d):
    """#6, #7, #22: lower-case k-mers with semicolons."""
    ws = Workspace(spark, "io")
    k = K.count_kmers(table(spark, d, "read_seqs"), "seq", k_).select(K.spell("kmer", k_).alias("kmer"))
    sinks.write_kmer_list(k, "kmer", ws.where("dot"))
    return text.read_kmer_list(spark, ws.where("dot"))


@query("SELECT hit_id::VARCHAR AS name, ((hit_id * 7) % 4096)::INT AS flag, coalesce(transcript_id::VARCHAR, '*') AS target, (hit_id % 997)::INT AS pos, (hit_id % 60)::INT AS mapq FROM kmer_hits")
def sam_roundtrip(spark, d):
    """#11: alignment lines after a header."""
    ws, h = Workspace(spark, "io"), F.col("hit_id")
    target = F.coalesce(F.col("transcript_id").cast("string"), F.lit("*"))
    line = F.concat_ws("\t", h.cast("string"), ((h * 7) % 4096).cast("string"), target, (h % 997 + 1).cast("string"), (h % 60).cast("string"), *map(F.lit, ("4M", "*", "0", "0", "ACGT", "IIII")))
    body = table(spark, d, "kmer_hits").select(line.alias("v"))
    head = spark.createDataFrame([("@HD\tVN:1.6",), ("@SQ\tSN:1\tLN:5000",)], "v string")
    sinks.write_lines(head.coalesce(1).unionByName(body), "v", ws.where("sam"))
    return text.read_sam(spark, ws.where("sam")).select("name", "flag", "target", "pos", "mapq")


@query(r"""SELECT seq_id, feature_type AS type, start_pos AS start, end_pos AS "end", strand, nullif(regexp_replace(transcript_id, '[\s;"=]', '', 'g'), '') AS transcript_id, nullif(regexp_replace(gene_id, '[\s;"=]', '', 'g'), '') AS gene_id
FROM transcript_genes WHERE feature_type IS NOT NULL AND seq_id IS NOT NULL AND strand IS NOT NULL AND start_pos IS NOT NULL AND end_pos IS NOT NULL""")
def gtf_attrs(spark, d):
    """#12: annotation lines, attributes quoted in one half and as key=value in the other."""
    ws = Workspace(spark, "io")
    clean = lambda c: F.regexp_replace(c, r'[\s;"=]', "")
    t = table(spark, d, "transcript_genes").where("feature_type is not null and seq_id is not null and strand is not null and start_pos is not null and end_pos is not null")
    odd = F.col("feature_id") % 2 == 1
    attr = lambda a: F.when(F.col(a).isNull(), F.lit("")).otherwise(F.when(odd, F.concat(F.lit(a + ' "'), clean(a), F.lit('";'))).otherwise(F.concat(F.lit(a + "="), clean(a), F.lit(";"))))
    line = F.concat_ws("\t", "seq_id", F.lit("src"), "feature_type", F.col("start_pos").cast("string"), F.col("end_pos").cast("string"), F.lit("."), "strand", F.lit("."), F.concat(attr("gene_id"), F.lit(" "), attr("transcript_id")))
    sinks.write_lines(t.select(line.alias("v")), "v", ws.where("gtf"))
    return text.read_gtf(spark, ws.where("gtf")).select("seq_id", "type", "start", "end", "strand", "transcript_id", "gene_id")


@query(r"SELECT DISTINCT transcript_id AS target, gene_id AS gene FROM transcript_genes WHERE regexp_full_match(transcript_id, '\S+') AND regexp_full_match(gene_id, '\S+')")
def t2g_map(spark, d):
    """#13: transcript and gene in two columns."""
    ws = Workspace(spark, "io")
    t = table(spark, d, "transcript_genes").where(F.col("transcript_id").rlike(r"^\S+$") & F.col("gene_id").rlike(r"^\S+$"))
    sinks.write_lines(t.select(F.concat_ws("\t", "transcript_id", "gene_id").alias("v")), "v", ws.where("t2g"))
    return text.read_target_genes(spark, ws.where("t2g"))


@query("SELECT name AS target, (row_number() OVER (ORDER BY name) - 1)::BIGINT AS tid, 'gene' AS gene FROM (SELECT DISTINCT name FROM transcripts WHERE name IS NOT NULL)")
def targets_only(spark, d):
    """#14: every target in one gene."""
    return text.targets_only(table(spark, d, "transcripts").where("name is not null"), "name")


@query("SELECT name, max(length) AS length, (count(*) * 1.5)::DOUBLE AS tpm, 0.25::DOUBLE AS fpkm, count(*)::DOUBLE AS num_reads FROM transcripts WHERE name IS NOT NULL GROUP BY name")
def quant_roundtrip(spark, d):
    """#17, #25: a result table of five columns with comments."""
    ws = Workspace(spark, "io")
    t = table(spark, d, "transcripts").where("name is not null").groupBy("name").agg(F.max("length").alias("length"), F.count(F.lit(1)).alias("n"))
    q = t.select("name", "length", (F.col("n") * 1.5).alias("tpm"), F.lit(0.25).alias("fpkm"), F.col("n").cast("double").alias("num_reads"))
    sinks.write_quant(q, ws.where("quant"), ["made from transcripts"])
    return text.read_quant(spark, ws.where("quant"), 5)


@query("SELECT name, max(length) AS length, 1.5::DOUBLE AS tpm, 2.5::DOUBLE AS rpkm, 3.5::DOUBLE AS kpkm, count(*)::DOUBLE AS est_kmers, 0.5::DOUBLE AS est_reads FROM transcripts WHERE name IS NOT NULL GROUP BY name")
def quant7_roundtrip(spark, d):
    """#17, #24: a result table of seven columns."""
    ws = Workspace(spark, "io")
    t = table(spark, d, "transcripts").where("name is not null").groupBy("name").agg(F.max("length").alias("length"), F.count(F.lit(1)).cast("double").alias("est_kmers"))
    q = t.select("name", "length", F.lit(1.5).alias("tpm"), F.lit(2.5).alias("rpkm"), F.lit(3.5).alias("kpkm"), "est_kmers", F.lit(0.5).alias("est_reads"))
    sinks.write_quant(q, ws.where("quant"))
    return text.read_quant(spark, ws.where("quant"), 7)


@query(f"WITH {COUNTS} SELECT kmer, cnt FROM counts")
def hash_text_roundtrip(spark, d):
    """#19: a count table as text."""
    ws = Workspace(spark, "io")
    c = K.count_kmers(table(spark, d, "read_seqs"), "seq", k_)
    sinks.write_lines(c.select(F.concat_ws(" ", K.spell("kmer", k_), F.col("cnt").cast("string")).alias("v")), "v", ws.where("hash"))
    return text.read_hash_text(spark, ws.where("hash"))


@query("""SELECT name, sum(x) OVER (PARTITION BY name)::DOUBLE AS total, p::INT AS pos, x::DOUBLE AS term FROM (
SELECT name, unnest(kmers) AS x, generate_subscripts(kmers, 1) - 1 AS p FROM (SELECT transcript_id AS name, max(kmers) AS kmers FROM transcripts WHERE kmers IS NOT NULL GROUP BY transcript_id))""")
def bias_terms(spark, d):
    """#18, #23: a dictionary of terms by name, written as one artefact of an index and read back: every term with its place and the sum."""
    ws = Workspace(spark, "io")
    t = table(spark, d, "transcripts").where("kmers is not null").groupBy(F.col("transcript_id").alias("name")).agg(F.max("kmers").alias("terms"))
    sinks.write_artefacts({"terms": t}, ws.where("index"))
    t = text.read_bias_terms(spark, ws.where("index") + "/terms")
    total = F.aggregate("terms", F.lit(0.0), lambda a, x: a + x)
    return t.where(F.size("terms") > 0).select("name", total.alias("total"), F.posexplode("terms").alias("pos", "term"))


@query(f"""WITH {TK} SELECT * FROM (SELECT 'targets' AS artefact, count(*) AS n_rows, sum(eff_len)::BIGINT AS checksum FROM lens
UNION ALL SELECT 'target_kmers', count(*), sum(occ)::BIGINT FROM tk UNION ALL SELECT 'kmers', count(*), sum(n)::BIGINT FROM (SELECT kmer, count(*) AS n FROM tk GROUP BY kmer)
UNION ALL SELECT 'counts', count(*), sum(cnt)::BIGINT FROM hits UNION ALL SELECT 'classes', count(*), sum(class_key)::BIGINT FROM (SELECT kmer, min(kmer) OVER (PARTITION BY v) AS class_key FROM (SELECT kmer, list(struct_pack(t := tid, o := occ) ORDER BY tid) AS v FROM tk GROUP BY kmer)))""")
def index_artefacts(spark, d):
    """#23: the whole index written and read back: targets with their lengths, k-mers of targets, k-mers with their targets, counts and classes."""
    ws = Workspace(spark, "io")
    tk = ws.write(I.target_kmers(table(spark, d, "transcripts"), "transcript_id", "kmers"), "tk")
    sums = {"targets": "eff_len", "target_kmers": "occ", "kmers": "n_targets", "counts": "cnt", "classes": "class_key"}
    sinks.write_artefacts(
        {"targets": tk.groupBy("tid").agg(F.sum("occ").alias("eff_len")), "target_kmers": tk, "kmers": I.inverted(tk), "counts": hits(spark, d), "classes": I.equivalence_classes(tk)}, ws.where("index")
    )
    out = None
    for name, column in sums.items():
        one = spark.read.parquet(f"{ws.where('index')}/{name}").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(column).alias("checksum")).select(F.lit(name).alias("artefact"), "*")
        out = one if out is None else out.unionByName(one)
    return out


_DI = ", ".join(f"di_{i:02d} int" for i in range(16))


@query(quant.ORACLE["gc_dinuc"])
def bias_feats_text(spark, d):
    """#28: the 19 columns of the bias features as text and back."""
    ws = Workspace(spark, "io")
    sinks.write_table(quant.gc_dinuc(spark, d), ws.where("features"))
    return text.read_table(spark, ws.where("features"), f"name long, length int, gc double, {_DI}")


@query(f"""SELECT name, value FROM (UNPIVOT (SELECT n_agree::VARCHAR AS n_agree, n_disagree::VARCHAR AS n_disagree, strand_bias::VARCHAR AS strand_bias, many_disagree::VARCHAR AS many_disagree
FROM ({mapping.ORACLE["libfmt_tally"]})) ON n_agree, n_disagree, strand_bias, many_disagree)""")
def libfmt_counts_text(spark, d):
    """#27: the tally of library formats as lines of text and back."""
    ws = Workspace(spark, "io")
    sinks.write_pairs(mapping.libfmt_tally(spark, d).drop("strand_ratio"), ws.where("counts"))
    return text.read_pairs_of_values(spark, ws.where("counts"))


@query(f"""WITH c AS ({mapping.ORACLE["posterior_mass"]}) SELECT kmer_id::VARCHAR AS name, CASE WHEN transcript_id IS NULL THEN 4 ELSE 0 END AS flag, coalesce(transcript_id::VARCHAR, '*') AS target
FROM (SELECT DISTINCT kmer_id FROM kmer_hits WHERE kmer_id <> -1) LEFT JOIN c USING (kmer_id)""")
def posterior_sam(spark, d):
    """#30, #72: one alignment a class, drawn by its hits, written as SAM with the unaligned ones, and read back."""
    ws = Workspace(spark, "io")
    every = table(spark, d, "kmer_hits").where(S.is_id("kmer_id")).select("kmer_id").distinct()
    x = every.join(mapping.posterior_mass(spark, d), "kmer_id", "left")
    missing = F.col("transcript_id").isNull()
    x = x.select(F.col("kmer_id").cast("string").alias("name"), F.when(missing, 4).otherwise(0).alias("flag"), F.col("transcript_id").cast("string").alias("target"), F.lit(0).alias("pos"), F.lit(255).alias("mapq"), F.lit(None).cast("string").alias("seq"))
    targets = table(spark, d, "transcripts").where("length is not null").groupBy(F.col("transcript_id").cast("string").alias("name")).agg(F.max("length").alias("length"))
    sinks.write_sam(x, ws.where("sam"), targets)
    return text.read_sam(spark, ws.where("sam")).select("name", "flag", "target")


@query(r"""SELECT doc_id, p AS path, regexp_matches(regexp_replace(lower(p), '\.(gz|bz2)$', ''), '\.(fa|fq|fasta|fastq)$') AS is_sequence FROM (SELECT doc_id, file_path || ['', '.fa', '.FQ.gz', '.fasta.bz2', '.fastq', '.fa.zip'][1 + doc_id % 6] AS p FROM documents WHERE file_path IS NOT NULL)""")
def sequence_paths(spark, d):
    """#79: whether a path ends like a sequence file; endings are added to the paths of the documents."""
    ends = F.array(*map(F.lit, ("", ".fa", ".FQ.gz", ".fasta.bz2", ".fastq", ".fa.zip")))
    t = table(spark, d, "documents").where("file_path is not null").select("doc_id", F.concat("file_path", F.element_at(ends, (1 + F.col("doc_id") % 6).cast("int"))).alias("path"))
    return t.withColumn("is_sequence", text.is_sequence_path(F.col("path")))


@query(rf"SELECT length(s) AS n, count(*) AS n_reads FROM (SELECT {_SEQ} AS s FROM read_seqs) WHERE s <> '' GROUP BY 1")
def stream_fasta_lengths(spark, d):
    """#9: FASTA files read as a stream, aggregated by length."""
    ws = Workspace(spark, "io")
    sinks.write_fasta(_named(spark, d).repartition(4), "name", "seq", ws.where("arriving"))
    out = stream_fasta(spark, ws.where("arriving")).groupBy(F.length("seq").cast("long").alias("n")).agg(F.count(F.lit(1)).alias("n_reads"))

    def keep(df, i):
        df.write.mode("overwrite").parquet(ws.where("out"))

    out.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", ws.where("progress")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(ws.where("out"))


@query(f"""WITH r AS (SELECT read_id, {_SEQ} AS s FROM read_seqs WHERE {_SEQ} <> ''), m AS (SELECT read_id, s, array_to_string(list_transform(generate_series(1, length(s)), lambda p:
CASE WHEN (read_id * 13 + p * 17) % 50 = 0 THEN translate(substr(s, p, 1), 'ACGT', 'CGTA') ELSE substr(s, p, 1) END), '') AS x FROM r)
SELECT read_id, round(len(list_filter(generate_series(1, length(s)), lambda p: substr(s, p, 1) <> substr(x, p, 1))) / length(s)::DOUBLE, 9) AS rate FROM m""")
def mutation_rate(spark, d):
    """Utilities: mutate every fiftieth position of a read, by a rule, and measure the share of changed ones."""
    r = _named(spark, d)
    m = r.withColumn("x", mutate(F.col("seq"), lambda p: (F.col("read_id") * 13 + p * 17) % 50 == 0))
    return m.select("read_id", F.round(rate(F.col("seq"), F.col("x")), 9).alias("rate"))


QUERIES, ORACLE = query.queries, query.oracle
