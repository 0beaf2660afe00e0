"""Writers. Every output is a folder of part files, as each task writes its own; a reader takes the folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_lines(df: DataFrame, column: str, path: str, compression: str = "none") -> None:
    df.select(F.col(column).alias("value")).write.mode("overwrite").option("compression", compression).text(path)


def write_fasta(df: DataFrame, name: str, seq: str, path: str, width: int = 0, compression: str = "none") -> None:
    """One record a row; with ``width``, sequences on lines of that length."""
    s = F.col(seq) if not width else F.rtrim(F.regexp_replace(seq, f"(.{{{width}}})", "$1\n"))
    write_lines(df.select(F.concat(F.lit(">"), F.col(name), F.lit("\n"), s).alias("v")), "v", path, compression)


def write_fastq(df: DataFrame, name: str, seq: str, qual: str, path: str, order: str | None = None, compression: str = "none") -> None:
    """With ``order`` the part files, read by name one after the other, are in that order, as paired output needs: ranges of it are
    sorted side by side."""
    rows = df.repartitionByRange(order).sortWithinPartitions(order) if order else df
    write_lines(rows.select(F.concat(F.lit("@"), F.col(name), F.lit("\n"), F.col(seq), F.lit("\n+\n"), F.col(qual)).alias("v")), "v", path, compression)


def write_kmer_list(df: DataFrame, kmer: str, path: str) -> None:
    """Lower-case k-mers or unitigs, each with a semicolon."""
    write_lines(df.select(F.concat(F.lower(kmer), F.lit(";")).alias("v")), "v", path)


def write_quant(df: DataFrame, path: str, comments: list[str] = ()) -> None:
    """Tab-separated result table; comments and the header go to part files of their own lines, marked with #."""
    cols = df.columns
    body = df.select(F.concat_ws("\t", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols)).alias("value"))
    head = df.sparkSession.createDataFrame([("# " + c,) for c in comments] + [("# " + "\t".join(cols),)], "value string")
    write_lines(head.coalesce(1).unionByName(body), "value", path)


def write_artefacts(tables: dict[str, DataFrame], path: str) -> None:
    """An index: one parquet folder for each of its tables."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def write_table(df: DataFrame, path: str, header: bool = False) -> None:
    """Tab-separated columns in order, nulls as nothing: bias features (name, length, GC and 16 dinucleotides), tallies and the like."""
    body = df.select(F.concat_ws("\t", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns)).alias("value"))
    if header:
        body = df.sparkSession.createDataFrame([("\t".join(df.columns),)], "value string").coalesce(1).unionByName(body)
    write_lines(body, "value", path)


def write_pairs(row: DataFrame, path: str) -> None:
    """The columns of a table of one row as lines "name: value", as counts of library formats are given."""
    cells = F.explode(F.array(*(F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in row.columns)))
    write_lines(row.select(cells.alias("value")), "value", path)


def write_sam(df: DataFrame, path: str, targets: DataFrame | None = None) -> None:
    """Alignment lines of (name, flag, target, pos, mapq, seq), pos from 0; a null target is an unaligned record. ``targets``: (name, length)
    of the header."""
    line = F.concat_ws(
        "\t", F.col("name"), F.col("flag").cast("string"), F.coalesce("target", F.lit("*")), F.when(F.col("target").isNull(), F.lit("0")).otherwise((F.col("pos") + 1).cast("string")),
        F.coalesce(F.col("mapq").cast("string"), F.lit("0")), F.when((F.col("target").isNull()) | F.col("seq").isNull(), F.lit("*")).otherwise(F.concat(F.length("seq").cast("string"), F.lit("M"))), *map(F.lit, "*00"), F.coalesce("seq", F.lit("*")), F.lit("*"),
    )
    lines = df.select(line.alias("value"))
    if targets is not None:
        head = targets.select(F.concat(F.lit("@SQ\tSN:"), F.col("name"), F.lit("\tLN:"), F.col("length").cast("string")).alias("value"))
        lines = head.unionByName(lines)
    write_lines(lines, "value", path)
