"""Readers and writers that no query covers, and the learners."""

import gzip
import random
import struct

import pytest
from pyspark.sql import functions as F

from seqloom.operators import learners
from seqloom.sources import bam, sinks, text

BASES = "=ACMGRSVTWYHKDBN"


def bam_bytes(targets, rows):
    out = b"BAM\1" + struct.pack("<i", 3) + b"@HD" + struct.pack("<i", len(targets))
    for name, length in targets:
        out += struct.pack("<i", len(name) + 1) + name.encode() + b"\0" + struct.pack("<i", length)
    for name, flag, ref, pos, mapq, seq in rows:
        codes = [BASES.index(c) for c in seq] + [0] * (len(seq) % 2)
        packed = bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2]))
        cigar = struct.pack("<I", len(seq) << 4) if ref >= 0 else b""
        body = struct.pack("<iiBBHHHiiii", ref, pos, len(name) + 1, mapq, 0, len(cigar) // 4, flag, len(seq), -1, -1, 0)
        body += name.encode() + b"\0" + cigar + packed + b"\xff" * len(seq) + b"NHC\1"
        out += struct.pack("<i", len(body)) + body
    return out


def test_bam_records(spark, tmp_path):
    rng = random.Random(1)
    targets = [("t1", 500), ("t two", 90)]
    rows = [(f"r{i}", rng.randint(0, 4095), ref := rng.choice([-1, 0, 1]), rng.randint(0, 400) if ref >= 0 else -1, rng.randint(0, 255), "".join(rng.choice("ACGTN") for _ in range(rng.randint(1, 40)))) for i in range(300)]
    for n, part in enumerate((rows[:200], rows[200:], [])):
        raw = bam_bytes(targets, part)
        with open(tmp_path / f"{n}.bam", "wb") as f:  # blocks, and the empty one at the end
            f.write(b"".join(gzip.compress(raw[i : i + 3000]) for i in range(0, len(raw), 3000)) + gzip.compress(b""))
    path = f"file://{tmp_path}"
    got = bam.read_bam(spark, path).orderBy("file", "line_no").collect()
    names = [t for t, _ in targets]
    assert [(r.name, r.flag, r.target, r.pos, r.mapq, r.seq) for r in got] == [(a, b, names[c] if c >= 0 else None, d, e, f) for a, b, c, d, e, f in rows]
    assert bam.bam_targets(spark, path).count() == 6
    with pytest.raises(ValueError):
        bam.inflate(gzip.compress(b"abc")[:-9])
    with pytest.raises(ValueError):
        bam.records(bam_bytes(targets, rows[:2])[:-3])


def test_ordered_output_in_parts_pairs_up(spark, tmp_path):
    df = spark.range(500).select("id", F.col("id").cast("string").alias("n"), F.lit("ACGT").alias("s"), F.lit("IIII").alias("q")).repartition(7)
    for i in (0, 1):
        sinks.write_fastq(df.where(f"id % 2 = {i}"), "n", "s", "q", f"{tmp_path}/m{i}", order="id")
    got = text.read_pairs(spark, f"{tmp_path}/m0", f"{tmp_path}/m1").orderBy("ordinal").collect()
    assert [(r.ordinal, r.name) for r in got] == [(i, str(2 * i)) for i in range(250)]


def test_sequence_paths(spark):
    paths = ["a.fa", "a.FQ.gz", "x/b.fasta.bz2", "b.fastq", "c.fa.zip", "fa", "c.txt"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    assert [r[0] for r in df.select(text.is_sequence_path(F.col("p"))).collect()] == [text.has_sequence_extension(p) for p in paths] == [True] * 4 + [False] * 3


def test_unaligned_records_survive(spark, tmp_path):
    rows = [("a", 0, "t", 4, 9, "ACG"), ("b", 4, None, None, None, "TT"), ("c", 4, None, 0, 0, None)]
    df = spark.createDataFrame(rows, "name string, flag int, target string, pos int, mapq int, seq string")
    sinks.write_sam(df, f"{tmp_path}/sam", spark.createDataFrame([("t", 9)], "name string, length int"))
    got = {r.name: (r.flag, r.target, r.pos, r.seq) for r in text.read_sam(spark, f"{tmp_path}/sam").collect()}
    assert got == {"a": (0, "t", 4, "ACG"), "b": (4, "*", -1, "TT"), "c": (4, "*", -1, "*")}
    assert [tuple(r)[1:] for r in text.sam_targets(spark, f"{tmp_path}/sam").collect()] == [("t", 9)]


@pytest.mark.parametrize("kind,classes", [("forest", False), ("forest", True), ("boosting", False), ("boosting", True)])
def test_learners_find_what_matters(spark, tmp_path, kind, classes):
    rng = random.Random(3)
    rows = [(x := rng.random(), rng.random(), (float(x > 0.5) if classes else 3 * x), 1) for _ in range(600)] + [(None, 0.1, 1.0, 1), (0.1, float("nan"), 1.0, 1), (0.2, 0.3, None, 1)]
    df = spark.createDataFrame(rows, "a double, b double, y double, prediction int")
    model, metrics = learners.fit(df, ["a", "b"], "y", kind, classes, trees=10, depth=3, held_back=0.3)
    assert metrics["accuracy" if classes else "r2"] > 0.9
    share = learners.importances(model, ["a", "b"])
    assert share["a"] > 0.8 and sum(share.values()) == pytest.approx(1)
    learners.save(model, f"file://{tmp_path}/model")
    new = spark.createDataFrame([(0.9, 0.5), (0.1, 0.5)], "a double, b double")
    again = [r.prediction for r in learners.load(f"file://{tmp_path}/model").transform(new).collect()]
    assert again == [r.prediction for r in model.transform(new).collect()] and again[0] > again[1]
    with pytest.raises(ValueError):
        learners.fit(df, ["a"], "y", "none")
