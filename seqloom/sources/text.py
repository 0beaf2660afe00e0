"""Readers of sequence and annotation text files as DataFrames.

Plain files are split among tasks; .gz and .bz2 are decoded by extension.  A list of paths is read as one bag.
Readers that need to know the place of a line in its file number the lines by block: every task counts the lines of
its blocks, a running sum per file over the blocks (one row a block) gives each block its first number, and no file has to
be read by one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SEQUENCE_EXTENSIONS = (".fa", ".fq", ".fasta", ".fastq")


def has_sequence_extension(path: str) -> bool:
    """Whether a file name, after .gz or .bz2, ends like a sequence file, in lower or upper case."""
    low = path.lower()
    for codec in (".gz", ".bz2"):
        low = low.removesuffix(codec)
    return low.endswith(SEQUENCE_EXTENSIONS)


def is_sequence_path(path: Column) -> Column:
    """The same of a column of paths."""
    return F.regexp_replace(F.lower(path), r"\.(gz|bz2)$", "").rlike(r"\.(fa|fq|fasta|fastq)$")


def read_table(spark: SparkSession, paths: str | list[str], schema: str) -> DataFrame:
    """Tab-separated text without a header."""
    return spark.read.csv(paths, sep="\t", schema=schema)


def read_pairs_of_values(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(name, value) of lines "name: value"."""
    f = F.split("value", ": ", 2)
    return spark.read.text(paths).select(f[0].alias("name"), f[1].alias("value"))


def listed_paths(spark: SparkSession, path: str) -> list[str]:
    """Paths of an input: a single path, or with a leading @ the lines of a list file, in no particular order."""
    if not path.startswith("@"):
        return [path]
    return [r.value.strip() for r in spark.read.text(path[1:]).where(F.trim("value") != "").collect()]  # a list of file names


def numbered_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, line_no from 0, value) of text files."""

    def count(batches):
        seen: dict = {}  # lines so far of each block of this task
        for b in batches:
            if not b.num_rows:
                continue
            file, block = b.column(0).dictionary_encode(), b.column(1).to_numpy()
            codes = file.indices.to_numpy()
            at = np.flatnonzero(np.concatenate(([True], (codes[1:] != codes[:-1]) | (block[1:] != block[:-1]))))
            idx = np.arange(b.num_rows)
            for i, j in zip(at, [*at[1:], b.num_rows]):
                key = file.dictionary[int(codes[i])].as_py(), int(block[i])
                first = seen.get(key, 0)
                idx[i:j] += first - i
                seen[key] = first + int(j - i)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(idx), b.column(2)], ["file", "block", "idx", "value"])

    raw = spark.read.text(paths).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    lines = raw.mapInArrow(count, "file string, block long, idx long, value string")
    blocks = raw.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    return lines.join(blocks, ["file", "block"]).select("file", (F.col("first") + F.col("idx")).alias("line_no"), "value")


def _clean(c: Column) -> Column:
    return F.regexp_replace(c, "[\r\n]", "")


def read_fasta(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(name, header, seq): records of FASTA files on one or many lines; name is the header up to the first space."""
    r = spark.read.option("lineSep", "\n>").text(paths).select(F.regexp_replace("value", "^>", "").alias("r")).where(F.trim("r") != "")
    header = F.regexp_replace(F.split("r", "\n", 2)[0], "\r$", "")
    seq = F.when(F.instr("r", "\n") > 0, _clean(F.split("r", "\n", 2)[1])).otherwise(F.lit(""))
    return r.select(F.split(header, "[ \t]", 2)[0].alias("name"), header.alias("header"), seq.alias("seq"))


def read_fastq(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, ordinal, name, header, seq, qual): complete four-line records; a record whose first line does not begin with
    @ or that is cut off is left out, and the quality is cut to the length of the sequence."""
    lines = numbered_lines(spark, paths).withColumn("value", F.regexp_replace("value", "\r$", ""))
    role = F.col("line_no") % 4
    pick = lambda i: F.max(F.when(role == i, F.col("value")))
    r = lines.groupBy("file", F.floor(F.col("line_no") / 4).alias("ordinal")).agg(pick(0).alias("h"), pick(1).alias("seq"), pick(2).alias("plus"), pick(3).alias("qual"))
    r = r.where(F.col("h").startswith("@") & F.col("plus").startswith("+") & F.col("qual").isNotNull())
    header = F.substring("h", 2, 1 << 30)
    return r.select("file", "ordinal", F.split(header, "[ \t]", 2)[0].alias("name"), header.alias("header"), "seq", F.expr("left(qual, length(seq))").alias("qual"))


def _one_after_the_other(records: DataFrame) -> DataFrame:
    """Records of :func:`read_fastq` numbered across files, in order of their names; there is one row a file to add up."""
    sizes = records.groupBy("file").agg((F.max("ordinal") + 1).alias("n"))
    before = sizes.select("file", F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return records.join(before, "file").withColumn("ordinal", F.col("before") + F.col("ordinal")).drop("before")


def read_pairs(spark: SparkSession, first: str, second: str) -> DataFrame:
    """(ordinal, name, seq1, seq2, qual1, qual2): two FASTQ files, or folders of part files, in lock-step, joined by position."""
    a, b = (_one_after_the_other(read_fastq(spark, p)) for p in (first, second))
    return a.select("ordinal", "name", F.col("seq").alias("seq1"), F.col("qual").alias("qual1")).join(b.select("ordinal", F.col("seq").alias("seq2"), F.col("qual").alias("qual2")), "ordinal")


def read_kmer_list(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(kmer): one lower-case k-mer and a semicolon a line, in upper case."""
    return spark.read.text(paths).select(F.upper(F.regexp_replace("value", ";?\r?$", "")).alias("kmer")).where("kmer <> ''")


def read_sam(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, line_no, name, flag, target, pos, mapq, seq): alignment lines of SAM text; pos from 0; header lines are left out."""
    f = F.split("value", "\t")
    lines = numbered_lines(spark, paths).where(~F.col("value").startswith("@") & (F.size(f) >= 11))
    return lines.select("file", "line_no", f[0].alias("name"), f[1].cast("int").alias("flag"), f[2].alias("target"), (f[3].cast("int") - 1).alias("pos"), f[4].cast("int").alias("mapq"), f[9].alias("seq"))


def sam_targets(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, name, length) of the @SQ header lines; files to be read together must agree in them."""
    h = spark.read.text(paths).select(F.col("_metadata.file_path").alias("file"), "value").where(F.col("value").startswith("@SQ\t"))
    return h.select("file", F.regexp_extract("value", "\tSN:([^\t]+)", 1).alias("name"), F.regexp_extract("value", "\tLN:([0-9]+)", 1).cast("int").alias("length"))


def read_gtf(spark: SparkSession, paths: str | list[str], attributes: tuple[str, ...] = ("transcript_id", "gene_id")) -> DataFrame:
    """Nine tab-separated fields of GTF or GFF and the named attributes, written as key "value"; or key=value."""
    f = F.split("value", "\t")
    lines = spark.read.text(paths).where(~F.col("value").startswith("#")).where(F.size(f) >= 9)
    value = lambda a: F.nullif(F.regexp_extract(f[8], rf'(?:^|[;\s]){a}(?:\s+"([^"]*)"|=([^;\s]*))', 1), F.lit(""))
    other = lambda a: F.nullif(F.regexp_extract(f[8], rf'(?:^|[;\s]){a}(?:\s+"([^"]*)"|=([^;\s]*))', 2), F.lit(""))
    return lines.select(
        f[0].alias("seq_id"), f[1].alias("source"), f[2].alias("type"), f[3].cast("int").alias("start"), f[4].cast("int").alias("end"),
        F.nullif(f[5], F.lit(".")).cast("float").alias("score"), f[6].alias("strand"), f[7].alias("phase"), *(F.coalesce(value(a), other(a)).alias(a) for a in attributes),
    )


def read_target_genes(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(target, gene) of two-column text, each pair once."""
    f = F.split(F.trim("value"), r"\s+")
    return spark.read.text(paths).where(F.size(f) >= 2).select(f[0].alias("target"), f[1].alias("gene")).distinct()


def targets_only(targets: DataFrame, name: str) -> DataFrame:
    """(target, tid, gene): every target numbered by name, all of one gene. Targets are numbered in one sort, so this is for
    lists of names, not for reads."""
    return targets.select(F.col(name).alias("target")).distinct().select("target", (F.row_number().over(Window.orderBy("target")) - 1).cast("long").alias("tid"), F.lit("gene").alias("gene"))


def read_quant(spark: SparkSession, paths: str | list[str], columns: int = 7) -> DataFrame:
    """Result tables of seven or five columns; comment lines are left out."""
    names = {7: "name string, length int, tpm double, rpkm double, kpkm double, est_kmers double, est_reads double", 5: "name string, length int, tpm double, fpkm double, num_reads double"}
    return spark.read.csv(paths, sep="\t", comment="#", schema=names[columns])


def read_comments(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return spark.read.text(paths).where(F.col("value").startswith("#"))


def read_hash_text(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(kmer, cnt) of a count table as text, k-mer and count separated by white space."""
    f = F.split("value", r"\s+")
    return spark.read.text(paths).select(f[0].alias("kmer"), f[1].cast("long").alias("cnt")).where("cnt is not null")


def read_bias_terms(spark: SparkSession, path: str) -> DataFrame:
    """(name, terms array<double>) of a parquet dictionary of bias terms."""
    return spark.read.parquet(path).select("name", F.col("terms").cast("array<double>").alias("terms"))
