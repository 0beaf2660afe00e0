import base64
import os
import random

import pytest
from pyspark.sql import functions as F

from seqloom.llm import garbled as G
from seqloom.llm.mixing import budgets, edges, mix
from seqloom.llm.tokenizer import DEFAULT_RANKS, PATTERN, Codec, encode, measure, read_ranks, serialise

needs_ranks = pytest.mark.skipif(not os.path.exists(DEFAULT_RANKS), reason="no vocabulary files")
TEXTS = ["", " ", "\n", "a", "it's 's 'LL we'll", "  two  spaces \n\n\ttab\r\n", "<|endoftext|> x", "é 漢字 🧪👨‍💻 ​﻿", "a\x1cb\x85c\xa0d e　 f", "1234 567abc_DEF-ghi", "\x00\x01", "x" * 20000, " " * 5000 + "y", "não"]

# -- 8


@needs_ranks
def test_ids_agree_with_the_rank_file():
    tiktoken = pytest.importorskip("tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(DEFAULT_RANKS, "rb"))}
    other = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    codec = Codec(serialise(read_ranks(DEFAULT_RANKS)), most_segments=50, most_pretokens=50)
    rng = random.Random(1)
    texts = TEXTS + ["".join(rng.choice(" \n\tab'sÉ漢1. ") for _ in range(60)) for _ in range(300)]
    for t in texts:
        assert codec.ids(t) == other.encode_ordinary(t), repr(t)
        assert codec.decode(codec.ids(t)) == t


@needs_ranks
def test_encode_table(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate([None, *TEXTS, "a"])], "doc_id long, text string, ids string")
    rows = {r.doc_id: r.ids for r in encode(df, "doc_id", "text").collect()}
    codec = Codec(serialise(read_ranks(DEFAULT_RANKS)))
    assert rows[0] == [] and rows[1] == [] and all(rows[i + 1] == codec.ids(t) for i, t in enumerate(TEXTS))
    assert encode(df.limit(0), "doc_id", "text").count() == 0
    n = {r.doc_id: (r.n_tokens, r.diversity) for r in measure(df, ["doc_id"], "text").collect()}
    assert n[0] == (0, 0.0) and all(n[i][0] == len(x) for i, x in rows.items()) and all(0 <= d <= 1 for _, d in n.values())


# -- 9


def test_budgets():
    assert budgets({}, {"a": (1.0, 2)}) == {}
    assert budgets({"a": 100, "b": 100, "c": 0}, {"a": (0.5, 1), "b": (0.3, 1), "c": (0.2, 9)}) == {"a": 100, "b": 60}
    assert budgets({"a": 10, "b": 1000}, {"a": (0.5, 4), "b": (0.5, 1)}) == {"a": 40, "b": 40}
    assert budgets({"a": 10, "b": 1000}, {"a": (0.5, 4), "b": (0.5, 1)}, total=200) == {"a": 40, "b": 100}


def test_mix_reaches_its_shares(spark):
    rng = random.Random(1)
    rows = [(i, "big" if i % 3 else rng.choice(["small", "other", None, "unlisted"]), rng.randint(0, 60), rng.random(), "x") for i in range(9000)]
    sized = spark.createDataFrame(rows, "doc_id long, source string, n_tokens long, quality double, copies string")
    w = spark.createDataFrame([("big", 0.5, 1, "r"), ("small", 0.3, 3, "r"), ("other", 0.1, 2, None), ("gone", 0.1, 5, None)], "source string, target_share double, max_repeats int, remark string")
    caps, size = {"big": 1, "small": 3, "other": 2}, {r[0]: r[2] for r in rows}
    have = {s: sum(r[2] for r in rows if r[1] == s) for s in caps}
    for total in (None, 60_000, 5_000):
        chosen, report = mix(sized, w, "doc_id", "source", "n_tokens", "quality", total=total, most_sorted=20, bins=4)
        used = {r.doc_id: r for r in chosen.collect()}
        assert all(1 <= r.copies <= caps[r.source] for r in used.values())
        rep = {r.source: r for r in report.collect()}
        assert rep["gone"].n_used == rep["gone"].n_target == 0
        for s, share in (("big", 0.5), ("small", 0.3), ("other", 0.1)):
            assert rep[s].n_used == sum(r.copies * size[i] for i, r in used.items() if r.source == s)
            assert abs(rep[s].n_target - (total or sum(have.values())) * share / 0.9) <= 1
            capped = min(rep[s].n_target, caps[s] * have[s])
            assert capped - 60 <= rep[s].n_used <= capped and rep[s].n_short == rep[s].n_target - rep[s].n_used
            copies = [used[i].copies if i in used else 0 for i, x, n, *_ in rows if x == s and n]
            assert max(copies) - min(copies) <= 1  # complete epochs first
        again = mix(sized.repartition(5), w, "doc_id", "source", "n_tokens", "quality", total=total)[0].collect()
        assert {r.doc_id: r.copies for r in again} == {i: r.copies for i, r in used.items()}  # neither partitions nor intervals matter
    few, quality = {i for i, r in used.items() if r.source == "big"}, {r[0]: r[3] for r in rows if r[1] == "big" and r[2]}
    mean = lambda ids: sum(quality[i] for i in ids) / len(ids)
    assert mean(few) > mean(quality.keys() - few)


def test_no_task_sorts_more_than_a_narrow_interval(spark):
    docs = spark.range(1_000_000).select(F.lit("a").alias("src"), F.lit(3).cast("long").alias("n"), (-F.log((F.xxhash64("id").bitwiseAND(F.lit((1 << 53) - 1)) + 0.5) / float(1 << 53)) / 0.05).alias("key"))
    e = edges(docs, {"a": 2_000_000}, most_sorted=1000)["a"]
    assert e.n_docs <= 1000 and e.before <= 2_000_000 < e.before + 3 * e.n_docs
    assert docs.where(F.col("key").between(e.low, e.high)).count() == e.n_docs and 3 * docs.where(F.col("key") < e.low).count() == e.before
    same = spark.range(50).select(F.lit("a").alias("src"), F.lit(3).cast("long").alias("n"), F.lit(1.5).alias("key"))
    assert edges(same, {"a": 30}, most_sorted=10)["a"].n_docs == 50  # a single key is not divided further


def test_mix_of_nothing(spark):
    sized = spark.createDataFrame([], "doc_id long, source string, n_tokens long, quality double")
    w = spark.createDataFrame([("a", 1.0, None)], "source string, target_share double, max_repeats int")
    chosen, report = mix(sized, w, "doc_id", "source", "n_tokens", "quality")
    assert chosen.count() == 0 and report.first().n_used == 0
    assert mix(sized, w.limit(0), "doc_id", "source", "n_tokens", "quality")[1].count() == 0


# -- 10

WORDS = ["código", "número", "función", "größe", "schlüssel", "données", "réseau", "źródło", "wartość", "również", "příkaz", "řádek", "память", "строка", "файл", "ключ", "αρχείο", "μνήμη", "読み込み", "設定", "错误", "写入", "nº", "ÂNGULO", "MAÇÃ", "ÞÝÐING", "’s", "“edge”", "é"]
KINDS = [("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "cp1251"), ("utf-8", "cp437"), ("cp1250", "cp1252"), ("cp1251", "cp1252"), ("koi8_r", "cp1251")]


def sentence(rng, words):
    return " ".join(rng.choice([rng.choice(words), "the row", "n = 4;"]) for _ in range(12))


def garble(text, right, wrong):
    try:
        raw = text.encode(right)
    except UnicodeEncodeError:
        return None
    return "".join(bytes([b]).decode(wrong, "ignore") or chr(b) for b in raw)


def test_garbled_documents_are_found_and_restored(spark):
    rng = random.Random(7)
    docs = [sentence(rng, rng.sample(WORDS, 6)) for _ in range(600)]
    docs += ['assert decode(b"\\xc3\\xa9") == "Ã©"', 'BAD = "�"', "plain", "", None, "​﻿🧪👨‍💻 éä \xa0x "]
    truth, original = set(), {}
    for i in range(120):
        right, wrong = KINDS[i % len(KINDS)]
        words = ["память", "строка", "файл", "ключ"] if right in ("cp1251", "koi8_r") else ["źródło", "wartość", "również"] if right == "cp1250" else WORDS[:22]
        t = sentence(rng, words)
        g = garble(t, right, wrong)
        if g and g != t:
            original[len(docs)] = t
            truth.add(len(docs))
            docs.append(g)
    truth.add(len(docs))
    docs.append("donn�es cl�")
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(docs)], "doc_id long, text string, run string")
    found = {r.doc_id for r in G.garbled_documents(df, "doc_id", "text").collect()}
    assert len(found - truth) <= 0.02 * len(truth) and len(truth - found) <= 0.05 * len(truth)
    back = {r.doc_id: r for r in G.restore(df, "doc_id", "text").collect()}
    assert set(back) == found
    assert sum(back[i].text == t for i, t in original.items() if i in back) >= 0.8 * len(original)
    assert back[len(docs) - 1].text == docs[-1] and back[len(docs) - 1].n_lost == 2


def test_short_quoted_literals_are_judged(spark):
    plain = ['BAD_CHAR = "�"', 'assert decode(b"\\xc3\\xa9", "latin") == "Ã©"', 'samples = ["Ã©", "Ã¼", "â€™"]', "name = 'ñ'; x", "a = '–' + b", 'y.count("�") > 1'] * 3
    bad = {'BAD_CHAR = "ï¿½"': plain[0], 'BAD_CHAR = "ÔøΩ"': plain[0], 'assert decode(b"\\xc3\\xa9", "latin") == "ÃƒÂ©"': plain[1], "name = 'Ã±'; x": plain[3], "a = 'â€“' + b": plain[4], 'z.count("пїЅ") > 1': 'z.count("�") > 1', 'sep = "�"': 'sep = "�"', 'BAD_CHAR = "���"': 'BAD_CHAR = "���"'}
    docs = [*plain, 't.replace("Ã©", "é")', *bad]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    back = {r.doc_id: r.text for r in G.restore(df, "doc_id", "text").collect()}
    assert {docs[i]: t for i, t in back.items()} == bad
    assert {r.doc_id for r in G.garbled_documents(df, "doc_id", "text").collect()} == set(back)


def test_runs_garbled_in_part_are_restored(spark):
    plain = ["il dit “été” là", "un été “chaud”", "l'été — là", "“été” et été", "说“你好”吧", "是“中文”字"] * 4
    bad = {"il dit “Ã©tÃ©” là": plain[0], "说â€œ你好”吧": plain[4]}
    docs = [*plain, *bad]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    back = {r.doc_id: r.text for r in G.restore(df, "doc_id", "text").collect()}
    assert {docs[i]: t for i, t in back.items()} == bad


def test_no_pair_is_left_out_of_a_large_table(spark):
    chars = [*map(chr, range(0x80, 0x600)), *map(chr, range(0x1E00, 0x2100))]
    t = "".join(f"{a}{b}" for a in chars for b in chars)  # more than four million pairs, each in three documents
    table = G.pair_table(spark.createDataFrame([(t,)] * 3, "text string"), "text")
    assert len(table) > 4_000_000
    pair = lambda a, b: G.class_of(ord(a)) << 12 | G.class_of(ord(b))
    assert all(table[pair(a, b)] == 3 for a, b in zip(chars[:200], chars[-200:])) and table[pair("a", "b")] == 0


def test_all_rounds_of_wrong_reading_are_undone(spark):
    plain, t = "un été là, l'été", "un été là, l'été"
    docs = [plain] * 3
    for _ in range(6):
        t = garble(t, "utf-8", "cp1252")
        docs.append(t)
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    assert {r.doc_id: r.text for r in G.restore(df, "doc_id", "text").collect()} == {i: plain for i in range(3, 9)}


def test_garbled_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert G.garbled_documents(df, "doc_id", "text").count() == 0 and G.restore(df, "doc_id", "text").count() == 0
    df = spark.createDataFrame([(1, None), (None, "Ã©"), (2, "a" * 100000)], "doc_id long, text string")
    assert G.garbled_documents(df, "doc_id", "text").count() == 0


def test_runs_are_linear_in_long_texts_and_take_in_all_that_adjoins():
    t = "x" * 400_000 + "é" + "y" * 400_000
    (i, j, key), = G.runs(t)
    assert (i, j) == (0, len(t)) and "é" in key
    assert [k for *_, k in G.runs('a "é" b')] == [] and len(list(G.runs("é" * 50_000))) == 1


def test_garbling_far_from_the_ends_of_a_word_is_restored(spark):
    plain = f"{'x' * 300}é{'y' * 300}"
    docs = [plain, plain, "né", "né", garble(plain, "utf-8", "cp1252")]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    assert {r.doc_id: r.text for r in G.restore(df, "doc_id", "text").collect()} == {4: plain}


def test_classes_are_bounded():
    import numpy as np

    every = np.arange(0x110000)
    c = G.classes(every)
    assert c.max() < G.N_CLASSES and all(G.class_of(int(x)) == max(32, c[x]) for x in [*range(0x3000), *range(0x3000, 0x110000, 97)])
    blocks = (c >= 0x0600) & (c < 0x060C) | (c >= 0x0F0C)
    assert (blocks == ~((every < 0x0600) | (every >= 0x1E00) & (every < 0x2700))).all()


def test_maximal_segments_are_those_of_the_definition():
    def slow(x, lo, hi):
        best = max(((sum(x[i:j]), -(j - i), -i, i, j) for i in range(lo, hi) for j in range(i + 1, hi + 1)), default=(0,))
        if best[0] <= 0:
            return []
        i, j = best[3:]
        return [*slow(x, lo, i), (i, j), *slow(x, j, hi)]

    rng = random.Random(4)
    for _ in range(400):
        x = [rng.uniform(-5, 5) for _ in range(rng.randint(0, 14))]
        assert G.maximal_segments(x) == slow(x, 0, len(x))
    assert len(G.maximal_segments([1.0, -2.0] * 100_000)) == 100_000


def test_segments_hold_the_improbable_and_leave_out_the_attested(spark):
    docs = ["año nuevo, año viejo"] * 500 + ["plain text"] * 200 + ["aÃ±o nuevo"]
    table = G.pair_table(spark.createDataFrame([(t,) for t in docs], "text string"), "text")
    assert table.n_docs == 701 and table[ord("a") << 12 | ord("ñ")] == 500
    assert G.segments(docs[0], table) == [] and G.segments("plain", table) == []
    (i, j), = G.segments(docs[-1], table)
    assert i <= 1 and j >= 3
    assert {k.split("\t")[1]: v for k, v in G.improbable_runs("viejo año aÃ±o", table).items()} == {"año": False, "aÃ±o": True}
    assert F is not None
