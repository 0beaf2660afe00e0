import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seqloom.llm.heavy_items import most_frequent, shrink, summary
from seqloom.llm.seen_keys import SeenKeys, batches
from seqloom.llm.term_counts import TermCounts, spell

RC = str.maketrans("ACGT", "TGCA")


def canon(w):
    return min(w, w[::-1].translate(RC))


# -- 1


@pytest.mark.parametrize("bits,n_batches", [(64, 5), (3, 4)])
def test_repeats_agree_with_a_set(spark, bits, n_batches):
    """Also with hashes of three bits, where nearly every hit is a false one and the full key decides."""
    rng = random.Random(bits)
    rows = [(i, rng.choice([None, "", "hot", *[f"k{j}" for j in range(40)]]) if rng.random() > 0.3 else "hot", "x", 1) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, k string, key string, h int")
    store = SeenKeys(spark, fanout=2, hash_bits=bits)
    for b in batches(df, "id", n_batches):
        store.ingest(b, "k", "id", answer=True)
    seen, expected = set(), set()
    for i, k, *_ in rows:
        if k is not None:
            if k in seen:
                expected.add(i)
            seen.add(k)
    assert sorted(r.ord for r in store.repeats().collect()) == sorted(expected)
    report = store.report().first()
    assert report.n_keys == len(seen) and (report.n_false_hits == 0) == (bits == 64)


@pytest.mark.parametrize("bits", [64, 2])
def test_late_keys_through_compactions_stay_one_row_a_key(spark, bits):
    """Keys that come again earlier and earlier, through merges of two levels: one row a key, with the earliest ord."""
    rng = random.Random(bits)
    store, first, rows = SeenKeys(spark, fanout=2, hash_bits=bits, buckets=3), {}, []
    for i in reversed(range(6)):
        part = [(rng.choice(["K", None, *[f"k{j}" for j in range(30)]]), 100 * i + j) for j in range(40)]
        rows += part
        store.ingest(spark.createDataFrame(part, "k string, t long"), "k", "t", answer=True)
        for k, t in part:
            if k is not None:
                first[k] = min(t, first.get(k, t))
    assert len(store.levels) > 2
    assert sorted(r.ord for r in store.repeats().collect()) == sorted(t for k, t in rows if k is not None and t > first[k])
    got = store.firsts().collect()
    assert len(got) == len(first) and {r.key: r.ord for r in got} == first
    assert store.report().first().n_keys == len(first)


def test_probe_with_late_rows(spark):
    store = SeenKeys(spark, fanout=2)
    for part in ([(1, 50), (2, 60), (None, 1)], [(1, 10), (3, 70)], [], [(1, 90), (3, 5)]):
        store.ingest(spark.createDataFrame(part, "k long, t long"), "k", "t")
    q = spark.createDataFrame([(1, 1, 11), (2, 1, 10), (3, 2, 61), (4, 3, 6), (5, 9, 99), (6, None, 99), (7, 1, None), (8, 1, 11)], "q long, k long, ord long")
    assert sorted(r.q for r in store.probe(q, "k", "ord").collect()) == [1, 3, 4, 8]


def test_repeats_with_an_earlier_row_in_a_later_batch(spark):
    seen = SeenKeys(spark, fanout=9, buckets=2)
    for r in [("A", 5), ("B", 1), ("A", 3), ("A", 4), ("B", 2)]:
        seen.ingest(spark.createDataFrame([r], "key string, id long"), "key", "id", answer=True)
    assert sorted(r.ord for r in seen.repeats().collect()) == [2, 4, 5]


def test_store_without_rows(spark):
    df = spark.createDataFrame([], "id long, k string")
    store = SeenKeys(spark)
    assert store.repeats().count() == 0 and store.probe(df, "k", "id").count() == 0 and store.report().first().n_keys == 0
    store.ingest(df, "k", "id", answer=True)
    assert store.repeats().count() == 0 and store.report().first().n_keys == 0


def test_store_is_opened_again_and_leaves_nothing_behind(spark, tmp_path):
    path, before = f"file://{tmp_path}/store", {r.tableName for r in spark.sql("show tables").collect()}
    settings = dict(spark.conf.getAll)
    one = spark.createDataFrame([("a", 1), ("b", 2)], "k string, t long")
    SeenKeys(spark, path=path).ingest(one, "k", "t", batch_id="one", answer=True)
    store = SeenKeys(spark, path=path)
    store.ingest(one, "k", "t", batch_id="one", answer=True)  # a retry
    store.ingest(spark.createDataFrame([("a", 3), ("c", 4)], "k string, t long"), "k", "t", batch_id="two", answer=True)
    again = SeenKeys(spark, path=path)
    assert [r.ord for r in again.repeats().collect()] == [3] and {r.key for r in again.firsts().collect()} == {"a", "b", "c"}
    assert {r.tableName for r in spark.sql("show tables").collect()} == before and dict(spark.conf.getAll) == settings


def scans_of(df):
    """Rows given out by each scan of an executed plan, and the plan."""
    df.collect()
    plan, out = df._jdf.queryExecution().executedPlan(), []

    def walk(p):
        name = p.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return walk(p.executedPlan())
        if name.endswith("QueryStageExec"):
            return walk(p.plan())
        if name == "FileSourceScanExec":
            out.append(p.metrics().apply("numOutputRows").value())
        for i in range(p.children().size()):
            walk(p.children().apply(i))

    walk(plan)
    return out, plan.toString()


def test_fences_leave_most_of_a_run_unread_and_nothing_is_sorted_or_shuffled(spark):
    store = SeenKeys(spark, buckets=2)
    store.ingest(spark.range(400_000).selectExpr("id as k", "id as t"), "k", "t")
    asked = store._flush(spark.createDataFrame([(5, 9), (7, 9)], "k long, t long"), F.col("k"), F.lit(None).cast("long"))
    rows, plan = scans_of(store.probed(asked))
    assert sum(rows) < 200_000 and "Sort " not in plan and "Exchange" not in plan
    whole, _ = scans_of(store.probed(store.runs[0]))
    assert max(whole) == 400_000


# -- 2


def brute_terms(rows, ks):
    occ, rec = Counter(), defaultdict(set)
    for i, g, s in rows:
        s = "".join((s or "").split()).upper()
        for p in range(len(s) - ks.get(g, 10**9) + 1):
            w = s[p : p + ks[g]]
            if set(w) <= set("ACGT"):
                occ[g, canon(w)] += 1
                rec[g, canon(w)].add(i)
    return {k: (n, len(rec[k])) for k, n in occ.items()}


def counts(store, ks):
    return {(r.g, r.kmer): (r.n_occ, r.n_rec) for r in spell(store.counts().withColumn("g", store.counts().grp), ks, "g int, n_occ long, n_rec long").collect()}


def test_deltas_agree_with_a_recount(spark):
    rng = random.Random(5)
    ks = {0: 4, 1: 7}
    seq = lambda: rng.choice([None, "", "NNNN", "AAAAAAAAAA", " ac gtn", "".join(rng.choice("ACGTacgtN") for _ in range(rng.randint(0, 40)))])
    live = {i: (i, rng.choice([0, 1, 2]), seq()) for i in range(80)}
    store = TermCounts(spark, ks, terms_per_part=50)
    delta = lambda rows: spark.createDataFrame([(g, s, sign, "x") for sign, (_, g, s) in rows], "grp int, seq string, sign int, occ string")
    store.apply(delta([(1, r) for r in live.values()]), 3000)
    assert counts(store, ks) == brute_terms(live.values(), ks)
    changes = []
    for i in range(0, 60, 3):  # change
        changes += [(-1, live[i]), (1, (i, live[i][1], s := seq()))]
        live[i] = (i, live[i][1], s)
    for i in range(1, 60, 3):  # delete
        changes.append((-1, live.pop(i)))
    for i in range(100, 120):  # add
        live[i] = (i, 1, seq())
        changes.append((1, live[i]))
    store.apply(delta(changes), 3000)
    assert counts(store, ks) == brute_terms(live.values(), ks)
    store.apply(delta([]), 0)
    assert counts(store, ks) == brute_terms(live.values(), ks)
    store.apply(delta([(-1, r) for r in live.values()]), 3000)
    assert counts(store, ks) == {}


def test_counts_are_opened_again_and_divided_as_they_grow(spark, tmp_path):
    rng = random.Random(6)
    path, ks, rows = f"file://{tmp_path}/terms", {0: 9}, []
    before, settings, parts = {r.tableName for r in spark.sql("show tables").collect()}, dict(spark.conf.getAll), []
    for i in range(4):
        new = [(100 * i + j, 0, "".join(rng.choice("ACGT") for _ in range(30))) for j in range(20 * 3**i)]
        rows += new
        store = TermCounts(spark, {} if i else ks, terms_per_part=300, path=path)
        for _ in range(2):  # the second time is a retry
            store.apply(spark.createDataFrame([(g, s, 1) for _, g, s in new], "grp int, seq string, sign int"), 30 * len(new), delta_id=str(i))
        assert counts(store, ks) == brute_terms([(n, g, s) for n, (_, g, s) in enumerate(rows)], ks)
        parts.append(store.state["parts"])
    assert parts[-1] >= 4 * parts[0] and store.counts().groupBy("part").count().agg({"count": "max"}).first()[0] < 600
    assert {r.tableName for r in spark.sql("show tables").collect()} == before and dict(spark.conf.getAll) == settings


def test_counts_of_nothing_and_of_a_long_read(spark):
    store = TermCounts(spark, {0: 31})
    store.apply(spark.createDataFrame([], "grp int, seq string, sign int"), 0)
    assert store.counts().count() == 0
    s = "".join(random.Random(1).choice("ACGT") for _ in range(300_000))
    store.apply(spark.createDataFrame([(0, s, 1)], "grp int, seq string, sign int"), len(s))
    assert store.counts().agg({"n_occ": "sum"}).first()[0] == len(s) - 30
    with pytest.raises(ValueError):
        TermCounts(spark, {0: 32})


# -- 5


def test_shrink_keeps_the_guarantee():
    rng = random.Random(2)
    stream = [rng.choice("ab") if rng.random() < 0.5 else f"x{rng.randint(0, 500)}" for _ in range(5000)]
    c, lost = Counter(), 0
    for i in range(0, 5000, 100):
        c.update(stream[i : i + 100])
        items, n, cut = shrink(pa.array([*c]), np.array([*c.values()], np.int64), 10)
        c, lost = Counter(dict(zip(items.to_pylist(), n.tolist()))), lost + cut
    true = Counter(stream)
    assert len(c) <= 10 and lost <= 5000 / 11 and all(c[x] <= true[x] <= c[x] + lost for x in true)


def test_summary_and_top(spark):
    rng = random.Random(3)
    rows = [(None if rng.random() < 0.1 else "hot" if rng.random() < 0.3 else f"k{min(rng.randint(0, 40), rng.randint(0, 3000))}", 1) for _ in range(20000)]
    df = spark.createDataFrame(rows, "item string, n int").repartition(23)
    true = Counter(x for x, _ in rows if x is not None)
    s = summary(df, "item", 64).collect()
    assert len(s) <= 64 and s[0].total == sum(true.values()) and s[0].lost <= s[0].total / 65
    found = {r.item: r.n for r in s}
    assert all(found.get(x, 0) <= n <= found.get(x, 0) + s[0].lost for x, n in true.items())
    best = most_frequent(df, "item", 5, k=16).collect()
    assert [r.n_rows for r in best] == [n for _, n in true.most_common(5)]


def test_top_of_few_ties_and_none(spark):
    assert most_frequent(spark.createDataFrame([], "x long"), "x", 3).count() == 0
    assert most_frequent(spark.createDataFrame([(None,)], "x long"), "x", 3).count() == 0
    got = most_frequent(spark.createDataFrame([(2,), (2,), (1,), (3,), (None,)], "x long"), "x", 10).collect()
    assert [(r.item, r.n_rows) for r in got] == [("2", 2), ("1", 1), ("3", 1)]


def test_top_of_even_frequencies(spark):
    df = spark.createDataFrame([(f"k{i:03}",) for i in range(300)] * 2, "x string").repartition(5)
    got = most_frequent(df, "x", 3, k=4, max_k=16).collect()
    assert all(r.n_rows == 2 and r.error_bound >= 2 and not r.guaranteed for r in got)
    got = most_frequent(df, "x", 3, k=4, max_k=1024).collect()
    assert [(r.item, r.n_rows, r.error_bound, r.guaranteed) for r in got] == [("k000", 2, 0, True), ("k001", 2, 0, True), ("k002", 2, 0, True)]
