import datetime as dt
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.functions import libfmt as L
from seqloom.functions import sequence as S
from seqloom.operators import abundance as A
from seqloom.operators import alignments as AL
from seqloom.operators import clusters, mapping
from seqloom.operators import index as I
from seqloom.operators.references import OrphanLedger, reference_key, replay
from seqloom.operators.skew import dominating, per_key
from seqloom.sources import sinks, text
from seqloom.streaming.online import OnlineAbundance, passes


def test_read_key(spark):
    rows = ["acgtt", " AAC\tGT\n", "NNN", "", None, "ttt", "ACN", " gat c"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in rows], "s string").select(S.read_key("s")).collect()]
    assert got == ["AACGT", "AACGT", None, None, None, "AAA", "ACN", "GATC"]


# -- hot keys


def test_per_key_with_a_hot_key_and_clashing_names(spark):
    rng = random.Random(1)
    rows = [(7 if rng.random() < 0.4 else rng.choice([None, -1, *range(50)]), rng.choice([None, 1, 2, 3]), "x") for _ in range(3000)]
    df = spark.createDataFrame(rows, "k long, t long, n_rows string")
    got = {r.k: (r.n_rows, r.n_distinct) for r in per_key(df, "k", distinct="t").collect()}
    n, t = Counter(r[0] for r in rows), defaultdict(set)
    for k, v, _ in rows:
        if v is not None:
            t[k].add(v)
    assert got == {k: (c, len(t[k])) for k, c in n.items()}
    assert {r.k for r in dominating(per_key(df, "k"), "k", 0.1).collect()} == {7}


def test_per_key_sums_and_empty(spark):
    df = spark.createDataFrame([], "k long, v double")
    assert per_key(df, "k", sums={"v": F.col("v")}).count() == 0
    assert dominating(per_key(df, "k"), "k", 0.5).count() == 0
    with pytest.raises(ValueError):
        per_key(df.withColumnRenamed("k", "n_rows"), "n_rows")


# -- orphans

T = dt.datetime(2025, 1, 1)


def day(x):
    return T + dt.timedelta(days=x)


def brute_orphans(refs, parents, grace):
    out = set()
    for table, field, row, key, at in refs:
        if key is None or at is None:
            continue
        if not any(f == field and k == key and a is not None and a <= at + dt.timedelta(days=grace) and (z is None or z > at) for f, _, k, a, z in parents):
            out.add((table, field, row, at.strftime("%Y-%m")))
    return out


REF = "table_name string, field string, row_id long, key string, loaded_at timestamp"
PAR = "field string, version long, key string, loaded_at timestamp, deleted_at timestamp"


@pytest.mark.parametrize("seed", [1, 2])
def test_orphans_agree_with_brute_force(spark, seed):
    rng = random.Random(seed)
    keys = [None, *"abcdefgh"]
    refs = [("t", f"f{rng.randint(0, 1)}", i, rng.choice(keys), rng.choice([None, day(rng.randint(0, 150))])) for i in range(60)]
    refs += refs[:5]
    parents = [(f"f{rng.randint(0, 1)}", i, rng.choice(keys), a := rng.choice([None, day(rng.randint(0, 150))]), rng.choice([None, day(rng.randint(0, 200))])) for i in range(25)]
    ledger = replay(OrphanLedger(spark, 7), spark.createDataFrame(refs, REF), spark.createDataFrame(parents, PAR))
    assert {tuple(r) for r in ledger.orphans().collect()} == brute_orphans(refs, parents, 7)
    assert ledger.history().count() > 0


def test_deletion_reopens_and_late_parent_resolves(spark):
    ledger = OrphanLedger(spark, 7)
    none_r, none_p = spark.createDataFrame([], REF), spark.createDataFrame([], PAR)
    ledger.advance("1", spark.createDataFrame([("t", "f", 1, "a", day(10)), ("t", "f", 2, "b", day(10))], REF), spark.createDataFrame([("f", 1, "a", day(1), None)], PAR))
    assert [r.row_id for r in ledger.orphans().collect()] == [2]
    ledger.advance("2", none_r, spark.createDataFrame([("f", 2, "b", day(12), None)], PAR))
    assert ledger.orphans().count() == 0
    # it becomes known that the parent had been deleted before the reference came
    ledger.advance("3", none_r, spark.createDataFrame([("f", 1, "a", day(1), day(5))], PAR))
    assert [r.row_id for r in ledger.orphans().collect()] == [1]
    ledger.advance("4", none_r, none_p)
    assert [r.row_id for r in ledger.orphans().collect()] == [1]


def test_ledger_goes_on_where_it_was_killed(spark, tmp_path):
    rng = random.Random(9)
    refs = [("t", "f", i, rng.choice("abcdef"), day(rng.randint(0, 400))) for i in range(80)]
    parents = [("f", i, rng.choice("abcdef"), day(a := rng.randint(0, 400)), rng.choice([None, day(a + rng.randint(0, 90))])) for i in range(20)]
    r, p, path = spark.createDataFrame(refs, REF), spark.createDataFrame(parents, PAR), f"file://{tmp_path}/ledger"

    class Killed(OrphanLedger):
        def _orphans_of(self, *args):
            if len(self.state["periods"]) == 5:
                raise RuntimeError("killed")
            return super()._orphans_of(*args)

    with pytest.raises(RuntimeError):
        replay(Killed(spark, 7, fanout=2, path=path), r, p)
    ledger = replay(OrphanLedger(spark, path=path), r, p)
    assert len(ledger.state["parents"]) <= 2 and len(ledger.state["periods"]) > 10
    assert {tuple(x) for x in ledger.orphans().collect()} == brute_orphans(refs, parents, 7)
    assert {tuple(x) for x in OrphanLedger(spark, path=path).orphans().collect()} == brute_orphans(refs, parents, 7)


def test_orphans_of_empty_tables(spark):
    ledger = replay(OrphanLedger(spark), spark.createDataFrame([], REF), spark.createDataFrame([], PAR))
    assert ledger.orphans().count() == 0 and ledger.history().count() == 0


def test_reference_key(spark):
    rows = [" A b\t", "", "\n ", None, "x "]
    assert [r[0] for r in spark.createDataFrame([(x,) for x in rows], "s string").select(reference_key("s")).collect()] == ["a b", None, None, None, "x"]


# -- index and abundance


def test_category_matrix(spark):
    """Columns with equal support are merged and their counts summed: a 3 x 7 matrix with known result."""
    a = [[0, 1, 0, 0, 1, 0, 2], [0, 0, 1, 0, 0, 1, 2], [0, 0, 0, 1, 0, 0, 0]]
    a = [[1, 0, 0, 0, 0, 0, 1], [0, 1, 0, 1, 0, 0, 1], [0, 0, 1, 0, 1, 0, 0]]
    counts = [4, 1, 2, 3, 3, 0, 5]
    tk = [(i, j, 1) for i, r in enumerate(a) for j, v in enumerate(r) if v]
    cls = I.equivalence_classes(spark.createDataFrame(tk, "tid long, kmer long, occ long"))
    c = spark.createDataFrame(list(enumerate(counts)), "kmer long, cnt long")
    got = {r.class_key: r.n for r in cls.join(c, "kmer").groupBy("class_key").agg(F.sum("cnt").alias("n")).collect()}
    assert got == {0: 4, 1: 4, 2: 5, 6: 5}


def test_multiplicity_separates_classes(spark):
    tk = spark.createDataFrame([(1, 1, 1), (2, 1, 1), (1, 2, 1), (2, 2, 2), (1, 3, 1), (2, 3, 1)], "tid long, kmer long, occ long")
    got = {r.kmer: r.class_key for r in I.equivalence_classes(tk).collect()}
    assert got == {1: 1, 2: 2, 3: 1}


def em_tables(spark, seed=3):
    rng = random.Random(seed)
    pairs = sorted({(c, t) for c in range(25) for t in rng.sample(range(8), rng.randint(1, 3))})
    classes = [(c, rng.randint(1, 300)) for c in range(25)]
    lengths = [(t, rng.randint(20, 200)) for t in range(8)]
    means = [(t, 1 / 8) for t in range(8)]
    return (
        spark.createDataFrame(means, "tid long, mean double"), spark.createDataFrame(classes, "class_key long, cnt long"),
        spark.createDataFrame([(c, t, 1) for c, t in pairs], "class_key long, tid long, occ long"), spark.createDataFrame(lengths, "tid long, eff_len long"),
    )


def test_both_ways_to_iterate_agree(spark):
    m, c, p, n = em_tables(spark)
    a = {r.tid: r.mean for r in A.iterate(m, c, p, n, 4).collect()}
    b = {r.tid: r.mean for r in A.solve(m, c, p, n, 4).collect()}
    d = {r.tid: r.mean for r in A.solve(m, c, p, n, 4, most_pairs=0).collect()}
    assert a == pytest.approx(b, abs=1e-9) and a == pytest.approx(d, abs=1e-9)
    assert sum(a.values()) == pytest.approx(1)


@pytest.mark.parametrize("accelerate,tolerance,prior,least,rounds", [(True, None, 0.01, 1.0, 4), (True, 0.5, 1.0, 1.0, 5), (False, 0.05, 0.1, 0.0, 30), (True, 5e-3, 0.01, 1.0, 40)])
def test_tables_and_arrays_take_the_same_steps(spark, accelerate, tolerance, prior, least, rounds):
    m, c, p, n = em_tables(spark)
    n = n.unionByName(spark.createDataFrame([(99, 30)], "tid long, eff_len long"))  # a target without a class
    one, two = ({r.tid: r for r in A.solve(m, c, p, n, rounds, tolerance, accelerate, prior, least, most_pairs=k).collect()} for k in (0, 10**6))
    assert {t: r.mean for t, r in one.items()} == pytest.approx({t: r.mean for t, r in two.items()}, abs=1e-9)
    assert {(r.rounds, r.converged) for r in one.values()} == {(r.rounds, r.converged) for r in two.values()} and len(one) == 9


def test_acceleration_reaches_the_fixed_point_sooner(spark):
    m, c, p, n = em_tables(spark)
    slow = {r.tid: r for r in A.solve(m, c, p, n, 1000, tolerance=1e-6).collect()}
    fast = {r.tid: r for r in A.solve(m, c, p, n, 1000, tolerance=1e-6, accelerate=True).collect()}
    assert all(r.converged for r in (*slow.values(), *fast.values())) and fast[0].rounds < slow[0].rounds
    assert {t: r.mean for t, r in slow.items()} == pytest.approx({t: r.mean for t, r in fast.items()}, abs=1e-4)
    assert not A.solve(m, c, p, n, 2, tolerance=1e-9).first().converged


def test_intervals_hold_the_mean(spark):
    m, c, p, n = em_tables(spark)
    means = A.solve(m, c, p, n, 1000, tolerance=1e-6, prior=0.1, least=0.0)
    rows = A.intervals(means, c).collect()
    assert len(rows) == 8 and all(0 <= r.low <= r.mean <= r.high <= 1 or r.mean < 1e-3 for r in rows)
    assert sum(r.mean for r in rows) == pytest.approx(1)


def test_acceleration_is_guarded():
    class Ops:
        """Steps that shrink a distance by half; extrapolations look worse than they are, so every round falls back to its two steps."""

        def __init__(self):
            self.tried = 0

        def step(self, m):
            return m / 2

        def change(self, a, b):
            return 1.0

        def norms(self, *_):
            return 3.0, 1.0

        def ahead(self, *_):
            self.tried += 1
            return np.array([-1000.0])

        def likelihood(self, m):
            return -abs(float(m[0])) * 10

    ops = Ops()
    m, rounds, done = A.drive(ops, np.array([1.0]), 5, None, True)
    assert m[0] == 2.0**-10 and ops.tried == 5 and (rounds, done) == (5, False)


def test_em_raises_the_likelihood(spark):
    m, c, p, n = em_tables(spark)
    one = A.em_step(m, c, p, n)
    assert A.log_likelihood(one, c, p, n).first()[0] > A.log_likelihood(m, c, p, n).first()[0]


def test_units(spark):
    x = spark.createDataFrame([(1, 100, 50.0), (2, 10, 0.0), (3, 0, 5.0)], "tid long, eff_len long, mass double")
    u = {r.tid: r for r in A.kmer_units(x, 21, 94.5).collect()}
    assert sum(r.tpm for r in u.values()) == pytest.approx(1e6) and u[3].kpkm == 0 and u[2].tpm == 0


def test_digamma(spark):
    got = spark.range(1).select(A.digamma(F.lit(1.0)), A.digamma(F.lit(0.5)), A.digamma(F.lit(1e6))).first()
    assert got[0] == pytest.approx(-0.5772156649015329, abs=1e-11) and got[1] == pytest.approx(-1.9635100260214235, abs=1e-11) and got[2] == pytest.approx(13.815510057964191, abs=1e-9)


def test_beta_quantiles_of_large_totals_take_few_steps(monkeypatch):
    """Quantiles are inverse to the distribution function, and a row takes some steps of Newton's method, not sixty halvings."""
    rows, plain = [], A.incomplete_beta
    monkeypatch.setattr(A, "incomplete_beta", lambda a, b, x: rows.append(len(x)) or plain(a, b, x))
    a = np.array([0.1, 0.6, 3.0, 40.0, 900.0, 2e4])
    for total in (3e4, 3e5):
        for p in (0.025, 0.5, 0.975):
            x = A.beta_quantile(a, total - a, p)
            assert ((x > 0) & (x < 1)).all() and plain(a, total - a, x) == pytest.approx(p, rel=1e-6)
    assert sum(rows) < 15 * 6 * len(a)


def test_beta_quantiles():
    b = np.array([0.1, 1.0, 2.0, 50.0, 1e6])
    one = np.ones(5)
    for p in (0.025, 0.5, 0.975):
        assert A.beta_quantile(one, b, p) == pytest.approx(1 - (1 - p) ** (1 / b), rel=1e-7)
        assert A.beta_quantile(b, one, p) == pytest.approx(p ** (1 / b), rel=1e-7, abs=1e-15)
    assert A.beta_quantile(b[1:], b[1:], 0.5) == pytest.approx(0.5, abs=1e-9)
    x = np.linspace(0.001, 0.999, 200_001)
    density = x**6.5 * (1 - x) ** 2.25
    sums = np.cumsum(density) / density.sum()
    assert A.incomplete_beta(np.array([7.5]), np.array([3.25]), np.array([x[140_000]])) == pytest.approx(sums[140_000], abs=1e-4)


def test_polytope():
    x = A.clamp(np.array([5.0, 3.0, 2.0]), np.array([0.0, 0.0, 4.0]), np.array([4.0, 10.0, 10.0]), 100)
    assert x.sum() == pytest.approx(10) and x[0] <= 4 and x[2] >= 4


def test_strand_choice(spark):
    df = spark.createDataFrame([(3, 3, 0), (3, 4, 0), (3, 4, 1), (3, 5, 1)], "f int, r int, x int")
    got = df.select(I.reverse_is_used(F.col("f"), F.col("r")).alias("a"), I.reverse_is_used(F.col("f"), F.col("r"), F.col("x")).alias("b")).collect()
    assert [tuple(r) for r in got] == [(False, False), (True, True), (True, False), (True, True)]


# -- formats, alignments, mapping


def test_every_format_survives_its_number(spark):
    df = spark.createDataFrame([(k,) for k in L.NAMES], "n string").select("n", L.parse(F.col("n")).alias("f"))
    for r in df.select("n", "f", L.from_number(L.number(F.col("f"))).alias("g"), L.is_valid(F.col("f")).alias("v")).collect():
        assert r.f == r.g and r.v and tuple(r.f) == L.NAMES[r.n]
    bad = spark.range(1).select(L.is_valid(L.struct("SE", "TOWARD", "U")), L.is_valid(L.struct("PE", "SAME", "SA")), L.is_valid(L.struct("PE", "NONE", "U")))
    assert tuple(bad.first()) == (False, False, False)


def test_anchored_clusters(spark):
    df = spark.createDataFrame([([0, 5, 10, 15, 20, 21, 40],), ([3],), ([],)], "v array<int>")
    assert [r[0] for r in df.select(mapping.anchors(F.col("v"))).collect()] == [[0, 15, 40], [3], []]


def test_frequent_seeds_are_thinned(spark):
    rng = random.Random(6)
    rest = "C" + "".join(rng.choice("ACGT") for _ in range(59))
    targets = spark.createDataFrame([(1, "A" * 900 + rest)], "tid long, s string")
    reads = spark.createDataFrame([(1, "A" * 19), (2, rest[5:40]), (3, None), (4, "AC")], "read_id long, s string")
    every = mapping.seeds(reads, "read_id", "s", targets, "tid", "s", 19, max_occ=None).where("fwd")
    some = mapping.seeds(reads, "read_id", "s", targets, "tid", "s", 19, max_occ=50).where("fwd")
    assert every.where("read_id = 1").count() == 882 and 40 <= some.where("read_id = 1").count() <= 50
    assert every.where("read_id = 2").count() == some.where("read_id = 2").count() == 17
    (m,) = mapping.exact_matches(some.where("read_id = 2"), "read_id", "tid", 19).collect()
    assert (m.rpos, m.tpos, m.qpos, m.len) == (0, 905, 0, 35)


@pytest.mark.parametrize("k", [4, 5])
def test_seeds_of_both_strands(spark, k):
    rng = random.Random(k)
    text = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    targets, reads = [(i, text(30)) for i in range(4)], [(i, text(12)) for i in range(20)] + [(99, "ACGTACGT")]
    rc = lambda w: w[::-1].translate(str.maketrans("ACGT", "TGCA"))
    expected = Counter()
    for i, s in reads:
        for fwd, x in ((True, s), (False, rc(s))):
            for p in range(len(x) - k + 1):
                q = p if fwd else len(x) - k - p
                expected.update((i, t, fwd, p, u, q) for t, y in targets for u in range(len(y) - k + 1) if y[u : u + k] == x[p : p + k])
    got = mapping.seeds(spark.createDataFrame(reads, "read_id long, s string"), "read_id", "s", spark.createDataFrame(targets, "tid long, s string"), "tid", "s", k)
    assert Counter(map(tuple, got.collect())) == expected


def test_super_maximal_matches(spark):
    rng = random.Random(8)
    rows = [(rng.randint(0, 5), rng.randint(0, 3), rng.random() < 0.5, 0, 0, q := rng.randint(0, 30), rng.randint(19, 50 - q)) for _ in range(120)]
    df = spark.createDataFrame(rows, "read_id long, tid long, fwd boolean, rpos int, tpos int, qpos int, len int")
    inside = lambda m, o: o[0] == m[0] and o[5] <= m[5] and o[5] + o[6] >= m[5] + m[6] and o[6] > m[6]
    assert Counter(map(tuple, mapping.super_maximal(df, "read_id").select(df.columns).collect())) == Counter(m for m in rows if not any(inside(m, o) for o in rows))


def test_adjacent_groups(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "a"), (1, 3, "b"), (1, 4, "a"), (2, 1, "a")], "f long, o long, n string")
    assert {(r.f, r.o): r.group_no for r in AL.adjacent_groups(df, "n", "o", "f").collect()} == {(1, 1): 1, (1, 2): 1, (1, 3): 2, (1, 4): 3, (2, 1): 1}


def test_posterior_choice_follows_the_weights(spark):
    df = spark.createDataFrame([(i, j, w) for i in range(2000) for j, w in ((0, 1.0), (1, 3.0), (2, 0.0))], "r long, j int, w double")
    few, one = (sorted((r.r, r.j) for r in AL.choose_by_posterior(df, "r", "j", "w", width=k).collect()) for k in (1024, 1))
    assert few == one  # how the sums are divided does not matter
    n = Counter(r.j for r in AL.choose_by_posterior(df, "r", "j", "w").collect())
    assert sum(n.values()) == 2000 and 0.70 < n[1] / 2000 < 0.80 and n[2] == 0


def test_clusters(spark):
    df = spark.createDataFrame([(1, 5), (1, 6), (2, 6), (2, 7), (3, 9), (None, 9), (4, None)], "g long, n long")
    assert {r.node: r.cluster for r in clusters.shared_members(df, "g", "n").collect()} == {5: 5, 6: 5, 7: 5, 9: 9}


def test_log_space(spark):
    df = spark.createDataFrame([(0.0, 0.0), (None, 1.0), (2.0, None), (1.0, 3.0)], "a double, b double")
    got = [tuple(r) for r in df.select(S.log_add(F.col("a"), F.col("b")), S.log_subtract(F.col("b"), F.col("a"))).collect()]
    assert got[0][0] == pytest.approx(np.log(2)) and got[0][1] is None and got[1] == (1.0, 1.0) and got[2][0] == 2.0
    assert got[3][1] == pytest.approx(np.log(np.exp(3) - np.exp(1)))


def test_online_shares(spark):
    m = OnlineAbundance(spark.createDataFrame([(1, 100), (2, 100), (3, None)], "tid long, length int"))
    hits = spark.createDataFrame([(1, 1), (2, 1), (2, 2), (2, 2), (3, 9)], "read_id long, tid long")
    for _ in range(3):
        m.update(hits)
    m.update(hits.limit(0))
    s = {r.tid: r.share for r in m.shares().collect()}
    assert sum(s.values()) == pytest.approx(1) and s[1] > s[2] > 0 and set(s) == {1, 2, 3}


def test_online_batches_in_order(spark, tmp_path):
    """All batches in one task, over tables, one by one and from a stream give the same masses; batch 3 is empty, batch 9 is not asked for."""
    rng = random.Random(5)
    targets = spark.createDataFrame([(t, rng.choice([None, 50, 200])) for t in range(0, 60, 2)], "tid long, length int")
    rows = [(r, rng.randrange(70), r % 6 + (r % 6 >= 3), rng.choice([None, -1.0, -0.2, 0.0])) for r in range(300) for _ in range(4)] + [(7, 2, 9, 0.0), (8, 2, None, 0.0)]
    hits = spark.createDataFrame(rows, "read_id long, tid long, b int, log_p double")
    for h in (hits, hits.drop("log_p")):
        one, arrays, tables, stream = (OnlineAbundance(targets) for _ in range(4))
        for b in range(8):
            one.update(h.where(F.col("b") == b))
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
        arrays.update_in_order(h, "b", range(8))
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) - jobs < 8  # not a few for each batch
        tables.update_in_order(h, "b", range(8), most_targets=3)
        folder = f"file://{tmp_path}/{len(h.columns)}"
        for lo, hi in ((0, 3), (4, 7)):
            h.where(F.col("b").between(lo, hi)).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream.follow(spark.readStream.schema(h.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in"), f"{folder}/progress", "b").awaitTermination()
        want = {r.tid: r.log_mass for r in one.state.collect()}
        for m in (arrays, tables, stream):
            got = {r.tid: r.log_mass for r in m.state.collect()}
            assert got == pytest.approx(want, abs=1e-9)
        assert arrays.log_weight == one.log_weight and arrays.step == one.step == 8
    assert passes(arrays, hits, "b", range(8), required=301) == 600 and arrays.step == 24


# -- files


def test_fasta_forms(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">x one\r\nACGT\r\nAC\r\n>y\n>z\tq\nAC\n\nGT\n")
    got = {(r.name, r.seq) for r in text.read_fasta(spark, f"file://{tmp_path}/a.fa").collect()}
    assert got == {("x", "ACGTAC"), ("y", ""), ("z", "ACGT")}


def test_fastq_across_blocks(spark, tmp_path):
    (tmp_path / "a.fq").write_text("".join(f"@r{i} c\n{'ACGT' * (i % 7)}\n+\n{'@III' * (i % 7)}\n" for i in range(500)) + "@cut\nAC\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        rows = {r.name: (r.ordinal, r.seq, r.qual) for r in text.read_fastq(spark, f"file://{tmp_path}/a.fq").collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert rows == {f"r{i}": (i, "ACGT" * (i % 7), "@III" * (i % 7)) for i in range(500)}


def test_extensions_and_gtf(spark, tmp_path):
    assert text.has_sequence_extension("x.FASTQ.gz") and text.has_sequence_extension("a.fa") and not text.has_sequence_extension("a.txt.gz")
    (tmp_path / "a.gtf").write_text('#c\nc1\ts\texon\t1\t9\t.\t+\t.\tgene_id "g 1"; transcript_id "t1"; old_gene_id "no";\nc1\ts\texon\t1\t9\t0.5\t-\t0\tID=q;gene_id=g2;transcript_id=t2\n')
    rows = [(r.transcript_id, r.gene_id, r.score) for r in text.read_gtf(spark, f"file://{tmp_path}/a.gtf").collect()]
    assert rows == [("t1", "g 1", None), ("t2", "g2", 0.5)]


def test_quant_table_keeps_comments(spark, tmp_path):
    q = spark.createDataFrame([("a", 5, 1.0, 2.0, 3.0)], "name string, length int, tpm double, fpkm double, num_reads double")
    sinks.write_quant(q, f"file://{tmp_path}/q", ["hello"])
    assert text.read_quant(spark, f"file://{tmp_path}/q", 5).collect() == q.collect()
    assert [r.value for r in text.read_comments(spark, f"file://{tmp_path}/q").collect()] == ["# hello", "# name\tlength\ttpm\tfpkm\tnum_reads"]
