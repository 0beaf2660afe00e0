import random
from collections import defaultdict

import numpy as np
import pytest

from seqloom.llm import shared_spans as S
from seqloom.llm.components import connected_components, star_edges
from seqloom.llm.shared_spans import shared_spans
from seqloom.plans.workspace import Workspace

# -- 6


def brute_groups(pairs):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("shape", ["random", "chain", "star", "empty"])
def test_components_agree_with_union_find(spark, shape):
    rng = random.Random(4)
    pairs = {
        "random": [(rng.choice([None, *range(300)]), rng.randint(0, 300)) for _ in range(250)] + [(5, 5), (1, 2), (1, 2), (2, 1)],
        "chain": [(i, i + 1) for i in rng.sample(range(200), 200)],
        "star": [(7, i) for i in range(500)] + [(10**12, 10**12 + 1)],
        "empty": [],
    }[shape]
    df = spark.createDataFrame([(a, b, 1) for a, b in pairs], "a long, b long, u int")
    assert {r.node: r.component for r in connected_components(df, "a", "b").collect()} == brute_groups(pairs)


def test_hot_group_becomes_a_star(spark):
    rows = [(0, i) for i in range(300)] * 2 + [(i, 300 + i // 2) for i in range(1, 40)] + [(None, 1), (3, None)]
    e = star_edges(spark.createDataFrame(rows, "g long, n long"), "g", "n", Workspace(spark, "t"), "x")
    assert e.count() < 400
    pairs, by = [], defaultdict(list)
    for g, n in rows:
        if g is not None and n is not None:
            by[g].append(n)
    for g in by.values():
        pairs += [(g[0], x) for x in g]
    assert {r.node: r.component for r in connected_components(e, "u", "v").collect()} == brute_groups(pairs)


# -- 7


def brute_spans(rows, width):
    where = defaultdict(set)
    win = lambda k: [tuple(k[p : p + width]) for p in range(len(k) - width + 1)]
    ok = lambda w: None not in w and -1 not in w
    for rec, k in rows:
        if rec is not None and k:
            for w in win(k):
                if ok(w):
                    where[w].add(rec)
    shared = defaultdict(set)
    for rec, k in rows:
        if rec is not None and k:
            for p, w in enumerate(win(k)):
                if len(where.get(w, ())) > 1:
                    shared[rec] |= set(range(p, p + width))
    out = set()
    for rec, pos in shared.items():
        start = None
        for p in sorted(pos):
            if p - 1 not in pos:
                start = p
            if p + 1 not in pos:
                out.add((rec, start, p))
    return out


@pytest.mark.parametrize("width,seed", [(3, 1), (8, 2), (32, 3)])
def test_spans_agree_with_brute_force(spark, width, seed):
    rng = random.Random(seed)
    base = [rng.randint(0, 10**9) for _ in range(400)]
    rows = []
    for rec in range(25):
        k = []
        while len(k) < 150:
            a = rng.randint(0, 350)
            k += rng.choice([base[a : a + rng.randint(1, 60)], [-1], [None], [184] * rng.randint(1, 50), [rng.randint(0, 9)]])
        rows.append((rec, k))
    rows += [rows[0], (30, None), (31, []), (None, base[:50]), (32, base[: width - 1]), (33, base[:width])]
    df = spark.createDataFrame([(r, k, 5) for r, k in rows], "t long, k array<long>, pos int")
    assert {tuple(r) for r in shared_spans(df, "t", "k", width).collect()} == brute_spans(rows, width)


def test_spans_of_nothing(spark):
    assert shared_spans(spark.createDataFrame([], "t long, k array<long>"), "t", "k", 4).count() == 0


def test_rolling_hash_is_a_polynomial_modulo_the_prime():
    rng = random.Random(2)
    x = np.array([rng.choice([-1, 0, 7, 2**63 - 1, -(2**63), rng.randint(-(2**62), 2**62)]) for _ in range(300)], np.int64)
    r = [int(v) for v in S._residues(x)]
    for width in (1, 2, 3, 31, 32, 33, 100, 300):
        slow = [sum(t * pow(S._BASE, width - 1 - j, S.PRIME) for j, t in enumerate(r[p : p + width])) % S.PRIME for p in range(300 - width + 1)]
        assert S.window_hashes(x, width).tolist() == slow


@pytest.mark.parametrize("width", [1024, 2048, 4096])
def test_words_that_meet_under_powers_of_two_do_not_meet(width):
    word = np.array([bin(i).count("1") & 1 for i in range(width)], np.int64)
    assert S.window_hashes(word, width)[0] != S.window_hashes(1 - word, width)[0]


@pytest.mark.parametrize("bits", [1, 5])
def test_windows_that_meet_under_a_hash_are_told_apart(spark, bits):
    rng = random.Random(bits)
    base = [rng.randint(0, 5) for _ in range(60)]
    rows = [(rec, base[(a := rng.randint(0, 40)) : a + rng.randint(0, 12)] + [rng.randint(0, 10**6) for _ in range(9)]) for rec in range(12)]
    rows.append((3, rows[5][1]))
    df = spark.createDataFrame(rows, "t long, k array<long>")
    assert {tuple(r) for r in shared_spans(df, "t", "k", 4, hash_bits=bits).collect()} == brute_spans(rows, 4)
