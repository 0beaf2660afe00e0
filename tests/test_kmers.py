import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seqloom.functions import mmers
from seqloom.functions.packing import buffers, packed_kmers, packed_runs, packed_windows, unpack, windows_of_runs
from seqloom.operators import dbg, kmerdb
from seqloom.operators import index as I
from seqloom.operators import kmers as K

RC = str.maketrans("ACGT", "TGCA")
EDGE = [None, "", " \t\n", "acg", "ACGTA", "ACGTAC", "NNNNNNNN", "NACGTACGTT", "ACGTNACGTT", "ACGTACGTTN", "acgtACGTacgt", "AAAAAAAAAA", "TTTTTTTTTT", "ACGCGT", "é" + "ACGTACG" + "é", "AC GT\tAC\nGT", "ACACACACACAC", "X" * 50 + "ACGTTTGCA"]


def rc(s):
    return s[::-1].translate(RC)


def windows(s, k):
    s = "".join((s or "").split()).upper()
    return [s[i : i + k] for i in range(len(s) - k + 1) if set(s[i : i + k]) <= set("ACGT")]


def brute(seqs, k, both=True):
    return Counter(min(w, rc(w)) if both else w for s in seqs for w in windows(s, k))


@pytest.mark.parametrize("k", [1, 2, 5, 6, 7, 16, 30, 31])
def test_packing_agrees_with_windows(k):
    rng = random.Random(k)
    rows = ["".join(rng.choice("ACGTN" if rng.random() < 0.2 else "ACGT") for _ in range(rng.randint(0, 90))) for _ in range(100)] + ["", None]
    values, row = packed_kmers(*buffers(pa.array(rows)), k)
    assert list(zip(row.tolist(), unpack(values, k).to_pylist())) == [(i, min(w, rc(w))) for i, s in enumerate(rows) for w in windows(s, k)]


@pytest.mark.parametrize("k", [3, 5, 6])
def test_counts_of_edge_cases(spark, k):
    df = spark.createDataFrame([(i, s, "x") for i, s in enumerate(EDGE)], "read_id long, seq string, kmer string")
    got = {r.kmer: r.cnt for r in K.count_kmers(df, "seq", k).select(K.spell("kmer", k).alias("kmer"), "cnt").collect()}
    assert got == brute(EDGE, k)
    text = {r.kmer: r["count"] for r in K.tokenise_text(df, "read_id", "seq", k, chunk=3).groupBy("kmer").count().collect()}
    assert text == brute(EDGE, k)


def test_empty_table(spark):
    df = spark.createDataFrame([], "read_id long, seq string")
    assert K.count_kmers(df, "seq", 5).count() == 0
    assert K.statistics(K.count_kmers(df, "seq", 5), 2, 9).first().n_total == 0
    assert dbg.unitigs(K.count_kmers(df, "seq", 5), "kmer", 5).count() == 0


def test_cut_off_then_cap(spark):
    df = spark.createDataFrame([(1, 1), (2, 2), (3, 255), (4, 256), (5, 1000), (6, 1001)], "kmer long, cnt long")
    assert {r.kmer: r.cnt for r in K.cut_off(df, 2, 1000, 255).collect()} == {2: 2, 3: 255, 4: 255, 5: 255}


def test_pack_and_spell(spark):
    words = ["A", "ACGT", "T" * 31, "ACGTN", "acg", None, ""]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = df.select("w", K.pack("w").alias("p")).collect()
    assert [r.p is None for r in got] == [False, False, False, True, True, True, True]
    back = df.where("w = repeat('T', 31)").select(K.spell(K.pack("w"), 31).alias("s")).first().s
    assert back == "T" * 31


def test_normalised_mmers():
    table = mmers.normalised(5)
    value = lambda s: sum("ACGT".index(c) * 4 ** (4 - i) for i, c in enumerate(s))
    for w in ("ACAGG", "CCTGT", "GAACG", "AATTT", "CGTTC"):  # the rules are alike for a word and its complement
        assert table[value(w)] == 4**5
    assert table[value("TGGGG")] == table[value("CCCCA")] == value("CCCCA")
    assert table[value("AACGC")] == value("AACGC")  # AA at the very front is allowed


def test_super_kmers_cover_every_kmer(spark):
    rng = random.Random(3)
    seqs = ["".join(rng.choice("ACGT") for _ in range(300)) for _ in range(5)] + ["A" * 700, "ACGT" * 10 + "N" + "ACGT" * 10]
    df = spark.createDataFrame(list(enumerate(seqs)), "read_id long, seq string")
    rows = K.super_kmers(df, "read_id", "seq", 15, 5, most=20).collect()
    assert max(r.len for r in rows) <= 15 + 20
    got = Counter(w for r in rows for w in windows(seqs[r.read_id][r.start : r.start + r.len], 15))
    assert got == Counter(w for s in seqs for w in windows(s, 15))


def test_database_limits(spark, tmp_path):
    c = spark.createDataFrame([(i, i) for i in range(2, 20)], "kmer long, cnt long")
    kmerdb.save(c, f"file://{tmp_path}/db", 9, 2, 100, 255)
    db = kmerdb.KmerDb(spark, f"file://{tmp_path}/db")
    assert db.k == 9 and db.count().first().n == 18
    assert not db.narrow(1) and not db.narrow(50, 40) and db.count().first().n == 18
    assert db.narrow(5, 10) and db.count().first().n == 6
    db.reset()
    assert db.count().first().n == 18


def test_quality_weights(spark):
    df = spark.createDataFrame([("ACGTA", [0, 1, 10, 20, 63]), ("ACG", [10, 10]), (None, None), ("ACG", None), ("TAC", [30, 30, 30])], "seq string, q array<int>")
    got = {r.kmer: r.weight for r in K.weighted_kmers(df, "seq", "q", 3).select(K.spell("kmer", 3).alias("kmer"), "weight").collect()}
    p = lambda q: 0.25 if q <= 1 else 1 - 10 ** (-q / 10)
    assert got["ACG"] == pytest.approx(p(0) * p(1) * p(10) + p(1) * p(10) * p(20))  # CGT folds to ACG
    assert got["GTA"] == pytest.approx(p(10) * p(20) * p(63) + p(30) ** 3)  # TAC and GTA are one
    assert set(got) == {"ACG", "GTA"}


def walk(kmers, k):
    """Unitigs by an independent walk over a set of canonical k-mers."""
    s = set(kmers)
    succ = lambda w: [w[1:] + c for c in "ACGT" if min(w[1:] + c, rc(w[1:] + c)) in s]
    pred = lambda w: [rc(x) for x in succ(rc(w))]

    def forward(w):
        n = succ(w)
        if len(n) != 1 or len(pred(n[0])) != 1 or min(n[0], rc(n[0])) == min(w, rc(w)):
            return None
        return n[0]

    seen, out = set(), []
    for start in sorted(s):
        if start in seen:
            continue
        left = start
        while (x := forward(rc(left))) is not None:
            left = rc(x)
            if left == start:
                break
        path, w = [left], left
        seen.add(min(left, rc(left)))
        while (x := forward(w)) is not None and x != left:
            path.append(x)
            seen.add(min(x, rc(x)))
            w = x
        out.append((path, x == left if x else False))
    return out


@pytest.mark.parametrize("k,n,seed", [(5, 60, 1), (5, 200, 2), (6, 80, 3), (7, 400, 4), (11, 500, 5)])
def test_unitigs_agree_with_a_walk(spark, k, n, seed):
    rng = random.Random(seed)
    genome = "".join(rng.choice("ACGT") for _ in range(n))
    kmers = sorted(brute([genome], k))
    check_unitigs(spark, kmers, k)


def test_circular_unitig(spark):
    ring = "ACGGTCATTGACC"
    kmers = sorted(brute([ring + ring[:6]], 7))
    rows = check_unitigs(spark, kmers, 7)
    assert len(rows) == 1 and rows[0].n_kmers == len(ring)


def check_unitigs(spark, kmers, k):
    df = spark.createDataFrame([(w,) for w in kmers], "w string").select(K.pack("w").alias("kmer"))
    rows = dbg.unitigs(df, "kmer", k).collect()
    assert Counter(rows) == Counter(dbg.unitigs(df, "kmer", k, most_steps=0).collect())
    assert brute([r.unitig for r in rows], k) == Counter(kmers)
    expected = walk(kmers, k)
    assert sorted(r.n_kmers for r in rows) == sorted(len(p) for p, _ in expected)
    mine = Counter(frozenset(min(w, rc(w)) for w in windows(r.unitig, k)) for r in rows)
    assert mine == Counter(frozenset(min(w, rc(w)) for w in p) for p, _ in expected)
    return rows


def test_edges_of_palindromes(spark):
    kmers = sorted(brute(["ACGT", "CGTA", "GACG"], 3))
    df = spark.createDataFrame([(w,) for w in kmers], "w string").select(K.pack("w").alias("kmer"))
    got = Counter(tuple(r) for r in dbg.edges(df, "kmer", 3).select(K.spell("src", 3), "src_end", K.spell("dst", 3), "dst_end").collect())
    out = {(w, "R"): w[1:] for w in kmers} | {(w, "L"): rc(w[:-1]) for w in kmers}
    assert got == Counter((a, x, b, y) for (a, x), p in out.items() for (b, y), q in out.items() if q == rc(p))


def test_least_above(spark):
    df = spark.createDataFrame([(1, 5), (5, 1), (7, 9), (1, 2), (3, 3)], "a long, b long")
    assert [r[0] for r in df.select(kmerdb.least_above("a", "b", 3)).collect()] == [5, 5, 7, -1, -1]


def test_power_bits():
    assert np.array_equal(mmers.little_endian(mmers.little_endian(np.arange(64), 3), 3), np.arange(64))


def test_hits_by_runs_of_windows(spark):
    """Hits of packed runs are those of windows one by one, and less than eight bytes a window are shuffled."""
    rng = random.Random(11)
    genome = "".join(rng.choice("ACGT") for _ in range(400))
    rows = [(1, None, "a"), (2, "ACGT", "a"), (3, "A" * 150, "a"), (4, "T" * 90, "b"), (5, "ACGTNACGT" * 9, None), (6, "AT" * 60, "b"), (7, "", "a"), (8, genome.lower(), "b")]
    for i in range(9, 120):
        at = rng.randrange(300)
        s = "".join(rng.choice("ACGTN") if rng.random() < 0.01 else c for c in genome[at : at + rng.randrange(10, 100)])
        rows.append((i, s[::-1].translate(str.maketrans("ACGT", "TGCA")) if rng.random() < 0.5 else s, rng.choice("ab")))
    reads = spark.createDataFrame(rows, "r long, s string, lib string")
    for k in (5, 12, 21, 31):
        index = K.count_kmers(reads.where("lib = 'a'"), "s", k, both_strands=False).select("kmer")
        want = sorted(I.read_hits(K.tokenise(reads, "r", "s", k), "r", index, k).collect())
        df = I.read_hits_among(reads, "r", "s", F.col("lib") == "a", k)
        assert want and sorted(df.collect()) == want
        longer = I.read_hits_among(reads, "r", "s", F.col("lib") == "a", k, F.length("s"))
        assert sorted(longer.collect()) == [(*w, len(dict((x[0], x[1]) for x in rows)[w[0]])) for w in want]
    offsets, raw = buffers(pa.array([x[1] for x in rows]))
    _, _, _, size, x, y = packed_runs(offsets, raw, 21)
    assert windows_of_runs(x, y, size.astype(np.int64), 21)[0].tolist() == packed_windows(offsets, raw, 21)[0].tolist()
    assert 20 * len(size) < 8 * int(size.sum())
