"""Places of whole stretches of reads in others, against the joined seeds, and what the queries on them shuffle."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from seqloom.functions.packing import buffers
from seqloom.operators import alignments as A
from seqloom.operators import bias
from seqloom.operators import containment as C
from seqloom.operators import mapping as M
from seqloom.plans import mapping as P

TURN = str.maketrans("ACGT", "TGCA")


def _write(spark, path, texts):
    rows = [(i + 1, s, "one", i % 3) for i, s in enumerate(texts)]
    spark.createDataFrame(rows, "read_id long, seq string, lib_code string, batch_no int").write.parquet(f"{path}/read_seqs.parquet")
    return str(path)


def _odd_reads():
    rnd = random.Random(5)
    base = lambda n: "".join(rnd.choice("ACGT") for _ in range(n))
    genome = base(900)
    texts = [None, "", "A", "NNNN", "acgtacgtacgtacgtacgt", "A" * 40, "T" * 70, "AC" * 30, base(18), base(19), base(20)]
    half = base(30)
    palindrome = half + half[::-1].translate(TURN)
    texts += [palindrome, palindrome[5:-5], palindrome[3:], half + "N" + half[::-1].translate(TURN)]
    unit = base(25)
    texts += [unit, unit * 3, unit + unit[:4] + unit, unit + base(40) + unit, unit + base(12) + unit[::-1].translate(TURN)]
    for _ in range(260):
        n = rnd.choice([19, 22, 34, 35, 60, 81, 82, 83, 100, 128, 300])
        at = rnd.randrange(len(genome) - n)
        s = genome[at : at + n]
        if rnd.random() < 0.2:
            i = rnd.randrange(n)
            s = s[:i] + rnd.choice("NRacgtACGT") + s[i + 1 :]
        if rnd.random() < 0.15:
            i = rnd.randrange(n)
            s = s[:i] + "N" + s[i:]
        texts += [s[::-1].translate(TURN) if rnd.random() < 0.5 else s] * rnd.choice([1, 1, 1, 2])
        if rnd.random() < 0.1:
            texts.append(s[::-1].translate(TURN))
    return texts


@pytest.mark.parametrize("most", [200, 9])
def test_best_places_are_those_of_the_joined_seeds(spark, tmp_path, monkeypatch, most):
    d = _write(spark, tmp_path, _odd_reads())
    monkeypatch.setattr(P, "MAX_OCC", most)
    old, new = P.Mapped(spark, d), P.Contained(spark, d)
    best = old.ws.write(old.best(), "best")
    reads = new.reads.select(F.col("read_id").alias("r"), F.col("tid").alias("of"), F.col("as_is").alias("s"))
    mine = new.best().join(reads, F.col("read_id") == F.col("of")).where("(s and as_is) or (not s and turned)")
    mine = mine.select(F.col("r").alias("read_id"), "tid", (F.col("fwd") == F.col("s")).alias("fwd"), "pos", "score")
    theirs = old.every(best).select("read_id", "tid", "fwd", "pos", "score")
    assert Counter(map(tuple, mine.collect())) == Counter(map(tuple, theirs.collect()))
    before = A.mismatch_matrix(P._on_targets(old), "read", "target")
    assert Counter(map(tuple, P.error_matrix(spark, d).collect())) == Counter(map(tuple, before.collect()))
    few = old.every(M.limit_hits(best, "read_id", 20).where("score >= 0.75").select("read_id", "tid"))
    assert Counter(map(tuple, P.max_read_occ(spark, d).collect())) == Counter(map(tuple, few.collect()))


def test_reads_of_targets_are_those_of_the_joined_seeds(spark, tmp_path, monkeypatch):
    d = _write(spark, tmp_path, _odd_reads())
    monkeypatch.setattr(bias, "correct", lambda values, features, value: values.join(features, "name").select("name", value, "length"))
    old = P.Mapped(spark, d)
    n = Counter(r.tid for r in old.every(old.best().where("score >= 0.75").select("read_id", "tid")).collect())
    size = {r.tid: len(r.seq) for r in old.targets.collect()}
    assert {(r.name, r.value, r.length) for r in P.bias_corrected(spark, d).collect()} == {(t, float(c), size[t]) for t, c in n.items()}


def test_packed_texts_come_back():
    import pyarrow as pa

    texts = ["", "A", "ACGT", "NACGT", "ACGTA", "GATTACA" * 9, "acgt", "AC GT", "TTT"]
    at, raw = C.unpack_texts(C.pack_texts(pa.array(texts)))
    offsets, plain = buffers(pa.array(texts))
    assert at.tolist() == offsets.tolist() and raw.tobytes() == plain.tobytes()


def _shuffled(spark):
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


@pytest.mark.parametrize("query", ["bias_corrected", "error_matrix", "max_read_occ"])
def test_seeds_are_not_shuffled(spark, tmp_path, monkeypatch, query):
    rnd = random.Random(3)
    genome = "".join(rnd.choice("ACGT") for _ in range(12_000))
    texts = [genome[i : i + 100] for i in (rnd.randrange(len(genome) - 100) for _ in range(4_000))]
    d = _write(spark, tmp_path, texts)
    monkeypatch.setattr(bias, "correct", lambda values, features, value: values.join(features, "name"))
    begin = _shuffled(spark)
    getattr(P, query)(spark, d).write.format("noop").mode("overwrite").save()
    assert _shuffled(spark) - begin < 5 * 100 * len(texts)
