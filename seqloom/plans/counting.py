"""Queries of the counter: k-mers of reads, signatures, count databases and set operations on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sequence as S
from ..operators import kmerdb
from ..operators import kmers as K
from .registry import Registry
from .workspace import Workspace, table

query = Registry()
k_, m_ = 21, 7

# -- SQL shared by the oracles

RC = "reverse(translate({0}, 'ACGT', 'TGCA'))"


def code4(s: str, m: int, little: bool = False) -> str:
    """Value of a word of m bases in base 4."""
    return "(" + " + ".join(f"(instr('ACGT', substr({s}, {i}, 1)) - 1) * {4 ** ((i - 1) if little else (m - i))}" for i in range(1, m + 1)) + ")"


def reads(where: str = "seq IS NOT NULL") -> str:
    return rf"reads AS (SELECT read_id, lib_code, upper(regexp_replace(seq, '\s+', '', 'g')) AS s FROM read_seqs WHERE {where})"


def windows(k: int, src: str = "reads", out: str = "win", cols: str = "read_id, lib_code") -> str:
    return f"""{out} AS (SELECT * FROM (SELECT {cols}, p, substr(s, p, {k}) AS w FROM (
  SELECT {cols}, s, unnest(generate_series(1, length(s) - {k - 1})) AS p FROM {src})) WHERE NOT regexp_matches(w, '[^ACGT]'))"""


def canonical(src: str = "win", out: str = "km") -> str:
    return f"{out} AS (SELECT *, least(w, {RC.format('w')}) AS kmer FROM {src})"


COUNTS = f"{reads()}, {windows(k_)}, {canonical()}, counts AS (SELECT kmer, count(*) AS cnt FROM km GROUP BY kmer)"
_BAD = r"'(TTT|TGT|TT.)$|.AA|^ACA'"


def norm_sql(w: str, m: int) -> str:
    special = 4**m
    rc = RC.format(w)
    return (
        f"least(CASE WHEN regexp_matches({w}, {_BAD}) THEN {special} ELSE {code4(w, m)} END, "
        f"CASE WHEN regexp_matches({rc}, {_BAD}) THEN {special} ELSE {code4(rc, m)} END)"
    )


def _reads(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "read_seqs").select("read_id", "lib_code", "seq")


def _counts(spark: SparkSession, d: str, k: int = k_) -> DataFrame:
    return K.count_kmers(_reads(spark, d), "seq", k)


def _text(df: DataFrame, k: int = k_) -> DataFrame:
    return df.withColumn("kmer", K.spell("kmer", k))


# -- counting


@query(f"WITH {COUNTS} SELECT kmer, cnt FROM counts")
def kmer_count(spark, d):
    """#36, #35, #86: canonical 21-mers of all reads and how often each occurs."""
    return _text(_counts(spark, d))


@query(f"WITH {COUNTS} SELECT kmer, least(cnt, 255) AS cnt FROM counts WHERE cnt BETWEEN 2 AND 1000000000")
def kmer_count_filtered(spark, d):
    """#64: kept from 2 on, capped at 255."""
    return _text(K.cut_off(_counts(spark, d)))


@query(f"WITH {reads()}, {windows(k_)} SELECT w AS kmer, count(*) AS cnt FROM win GROUP BY w")
def kmer_noncanonical(spark, d):
    """#86 without strand folding."""
    return _text(K.count_kmers(_reads(spark, d), "seq", k_, both_strands=False))


@query(f"WITH {reads()}, {windows(40)}, {canonical()} SELECT kmer, count(*) AS cnt FROM km GROUP BY kmer")
def kmer_count_long(spark, d):
    """#36, #86 for k above 31: 40-mers as text, tokenised inside the JVM."""
    return K.tokenise_text(_reads(spark, d), "read_id", "seq", 40).groupBy("kmer").agg(F.count(F.lit(1)).alias("cnt"))


@query(f"""WITH {COUNTS} SELECT count(*) FILTER (cnt < 2) AS n_below_min, count(*) FILTER (cnt > 100) AS n_above_max, count(*) AS n_unique,
count(*) FILTER (cnt BETWEEN 2 AND 100) AS n_unique_counted, sum(cnt)::BIGINT AS n_total, (SELECT count(*) FROM read_seqs WHERE seq IS NOT NULL) AS n_reads FROM counts""")
def kmer_count_stats(spark, d):
    """#88: statistics of a run with ci 2 and cx 100."""
    n = _reads(spark, d).agg(F.count("seq").alias("n_reads"))
    return K.statistics(_counts(spark, d), 2, 100).join(F.broadcast(n))  # two single rows


_Q = "CASE WHEN q <= 1 THEN 0.25::DOUBLE ELSE 1.0::DOUBLE - power(10.0::DOUBLE, -q / 10.0::DOUBLE) END"


@query(f"""WITH {reads()}, quals AS (SELECT read_id, lib_code, s, list_transform(generate_series(0, length(s) - 1), lambda p: (read_id * 31 + p * 7) % 41) AS qs FROM reads),
{windows(k_, "quals", cols="read_id, lib_code, qs")}, {canonical()},
w2 AS (SELECT kmer, list_reduce(list_transform(qs[p : p + {k_ - 1}], lambda q: {_Q}), lambda a, x: a * x, 1.0::DOUBLE) AS weight FROM km)
SELECT kmer, round(sum(weight), 6) AS weight FROM w2 GROUP BY kmer""")
def kmer_quality_count(spark, d):
    """#45, #66, #87: sum over occurrences of the probability that all bases are right; qualities made from position."""
    r = _reads(spark, d).where("seq is not null").withColumn("s", S.squeeze("seq"))
    q = F.when(F.length("s") > 0, F.transform(F.sequence(F.lit(0), F.length("s") - 1), lambda p: ((F.col("read_id") * 31 + p * 7) % 41).cast("int")))
    w = K.weighted_kmers(r.withColumn("quals", q), "s", "quals", k_)
    return _text(w).withColumn("weight", F.round("weight", 6))


@query(f"WITH {COUNTS} SELECT kmer, cnt FROM counts ORDER BY cnt DESC, kmer LIMIT 10")
def kmer_topk(spark, d):
    """#115, #117: the ten most frequent k-mers."""
    return _text(_counts(spark, d).orderBy(F.desc("cnt"), "kmer").limit(10))


@query(f"WITH {COUNTS} SELECT kmer FROM counts")
def kmer_distinct(spark, d):
    """#122: the distinct k-mers."""
    return _text(_counts(spark, d)).select("kmer")


@query(f"WITH {COUNTS} SELECT kmer || chr(9) || least(cnt, 255) AS line FROM counts WHERE cnt >= 2")
def kmer_dump(spark, d):
    """#21, #63: lines of a dump, k-mer, tab, count."""
    return kmerdb.dump(_text(K.cut_off(_counts(spark, d))), "kmer", "cnt")


@query(f"WITH {COUNTS} SELECT kmer, least(cnt, 255) AS cnt FROM counts WHERE cnt BETWEEN 2 AND 1000000000")
def kmerdb_roundtrip(spark, d):
    """#15, #16, #20: a count database written, opened and listed."""
    ws = Workspace(spark, "kmerdb")
    kmerdb.save(K.cut_off(_counts(spark, d)), ws.where("db"), k=k_, ci=2, cx=10**9, cs=255)
    return _text(kmerdb.KmerDb(spark, ws.where("db")).listing())


# -- signatures


@query(f"WITH {COUNTS} SELECT kmer, list_min([{', '.join(norm_sql(f'substr(kmer, {i}, {m_})', m_) for i in range(1, k_ - m_ + 2))}])::INT AS signature FROM counts")
def kmer_signature(spark, d):
    """#38, #39: signature of every distinct k-mer."""
    c = _counts(spark, d).withColumn("signature", K.signature("kmer", k_, m_))
    return _text(c).select("kmer", "signature")


@query(f"WITH {reads()}, {windows(m_)} SELECT w AS mmer, {norm_sql('w', m_)}::INT AS norm FROM (SELECT DISTINCT w FROM win)")
def mmer_norm(spark, d):
    """#33, #34, #38: normalised value of every 7-mer of the reads, as expressions."""
    mm = K.count_kmers(_reads(spark, d), "seq", m_, both_strands=False).select(K.spell("kmer", m_).alias("mmer"), F.col("kmer").alias("own"))
    rc = S.reverse_complement("mmer")
    special = F.lit(4**m_).cast("long")
    a = F.when(F.col("mmer").rlike(K.mmers.NOT_ALLOWED), special).otherwise(F.col("own"))
    b = F.when(rc.rlike(K.mmers.NOT_ALLOWED), special).otherwise(K.pack(rc))
    return mm.select("mmer", F.least(a, b).cast("int").alias("norm"))


_SIG = f"""sig AS (SELECT read_id, p, list_min([{', '.join(norm_sql(f'substr(w, {i}, {m_})', m_) for i in range(1, k_ - m_ + 2))}])::INT AS signature FROM win)"""
_SUPER = f"""{reads()}, {windows(k_)}, {_SIG},
brk AS (SELECT *, CASE WHEN lag(p) OVER t = p - 1 AND lag(signature) OVER t = signature THEN 0 ELSE 1 END AS b FROM sig WINDOW t AS (PARTITION BY read_id ORDER BY p)),
seg AS (SELECT *, sum(b) OVER (PARTITION BY read_id ORDER BY p) AS g FROM brk),
super AS (SELECT read_id, (min(p) - 1)::INT AS start, (count(*) + {k_ - 1})::INT AS len, min(signature) AS signature FROM seg GROUP BY read_id, g)"""


@query(f"WITH {_SUPER} SELECT read_id, start, len, signature FROM super")
def superkmer_segments(spark, d):
    """#108: super-k-mers of every read (reads here are shorter than the cut)."""
    return K.super_kmers(_reads(spark, d), "read_id", "seq", k_, m_)


@query(f"WITH {_SUPER} SELECT signature, count(*) AS n_super, sum(len - {k_ - 1})::BIGINT AS n_kmers FROM super GROUP BY signature")
def signature_hist(spark, d):
    """#90: super-k-mers and k-mers per signature, over all of the input."""
    s = K.super_kmers(_reads(spark, d), "read_id", "seq", k_, m_)
    return s.groupBy("signature").agg(F.count(F.lit(1)).alias("n_super"), F.sum(F.col("len") - (k_ - 1)).alias("n_kmers"))


_M = 4
_RANK = f"""mm AS (SELECT substr(kmer, i, {_M}) AS w FROM (SELECT kmer, unnest(generate_series(1, {k_ - _M + 1})) AS i FROM counts)),
hist AS (SELECT {code4('w', _M, little=True)}::BIGINT AS code, count(*) AS cnt FROM mm GROUP BY w),
ranked AS (SELECT code, cnt, (row_number() OVER (ORDER BY cnt, code) - 1)::BIGINT AS rank FROM hist)"""


def _ranked(kmers: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    h = K.mmer_histogram(kmers, "kmer", k_, _M)  # at most 4^m rows, so one partition is enough to rank them
    return h.withColumn("rank", (F.row_number().over(Window.orderBy("cnt", "code")) - 1).cast("long"))


@query(f"WITH {COUNTS}, {_RANK} SELECT code, cnt, rank FROM ranked")
def mmer_rank(spark, d):
    """#40, #91, #109: 4-mers of the distinct k-mers by ascending frequency."""
    return _ranked(_counts(spark, d))


@query(f"WITH {COUNTS}, {_RANK} SELECT code, cnt FROM hist ORDER BY cnt DESC, code LIMIT 3")
def mmer_top3(spark, d):
    """#118: the three most frequent 4-mers."""
    return _ranked(_counts(spark, d)).select("code", "cnt").orderBy(F.desc("cnt"), "code").limit(3)


_NODES = f"""word AS (SELECT c, {' || '.join(f"substr('ACGT', (c // {4**i}) % 4 + 1, 1)" for i in range(_M))} AS w FROM (SELECT unnest(generate_series(0, {4**_M - 1})) AS c)),
word_rank AS (SELECT word.w, coalesce(ranked.rank, 0) AS rank FROM word LEFT JOIN ranked ON code = c),
best AS (SELECT a.w, least(a.rank, b.rank) AS rank FROM word_rank a JOIN word_rank b ON b.w = {RC.format('a.w')}),
mid AS (SELECT kmer, min(rank) FILTER (p > 1 AND p <= {k_ - _M}) AS middle, min(rank) FILTER (p = 1) AS l, min(rank) FILTER (p = {k_ - _M + 1}) AS rr
  FROM (SELECT kmer, unnest(generate_series(1, {k_ - _M + 1})) AS p FROM counts) JOIN best ON best.w = substr(kmer, p, {_M}) GROUP BY kmer),
nodes AS (SELECT kmer, least(l, middle)::BIGINT AS left_min, least(rr, middle)::BIGINT AS right_min FROM mid)"""


def _nodes(spark, d) -> DataFrame:
    kmers = Workspace(spark, "nodes").write(_counts(spark, d).select("kmer"), "kmers")
    ranks = {r.code: r.rank for r in _ranked(kmers).collect()}  # at most 4^m rows
    return K.node_minimizers(kmers, "kmer", k_, _M, ranks)


@query(f"WITH {COUNTS}, {_RANK}, {_NODES} SELECT kmer, left_min, right_min FROM nodes")
def node_minimizers(spark, d):
    """#41, #42: minimizers of the ends of every distinct k-mer."""
    return _text(_nodes(spark, d))


@query(f"""WITH {COUNTS}, {_RANK}, {_NODES} SELECT kmer, CASE WHEN least(left_min, right_min) > 100 THEN least(left_min, right_min)
WHEN greatest(left_min, right_min) > 100 THEN greatest(left_min, right_min) ELSE -1 END AS next_bucket FROM nodes""")
def minbutbigger(spark, d):
    """#43: the bucket a node goes to next, after bucket 100."""
    return _text(_nodes(spark, d)).select("kmer", kmerdb.least_above("left_min", "right_min", 100).alias("next_bucket"))


# -- databases of libraries


def _lib(spark, d, code) -> DataFrame:
    return K.count_kmers(_reads(spark, d).where(F.col("lib_code") == code), "seq", k_)


_LIBS = f"""{COUNTS}, a AS (SELECT kmer, count(*) AS cnt FROM km WHERE lib_code = 'rna_1' GROUP BY kmer),
b AS (SELECT kmer, count(*) AS cnt FROM km WHERE lib_code = 'rna_2' GROUP BY kmer)"""


@query(f"WITH {_LIBS} SELECT kmer, sum(cnt)::BIGINT AS cnt FROM (FROM a UNION ALL FROM b) GROUP BY kmer HAVING sum(cnt) BETWEEN 2 AND 1000")
def kmerdb_merge(spark, d):
    """#116, merge of count databases of two libraries, with a filter on the summed counts."""
    return _text(kmerdb.merge([_lib(spark, d, "rna_1"), _lib(spark, d, "rna_2")], least=2, most=1000))


@query(f"WITH {_LIBS} SELECT kmer FROM a UNION SELECT kmer FROM b")
def kmer_union(spark, d):
    """#123 on k-mers."""
    return _text(kmerdb.merge([_lib(spark, d, "rna_1"), _lib(spark, d, "rna_2")]).select("kmer"))


@query(f"WITH {_LIBS} SELECT kmer, a.cnt AS cnt_a, b.cnt AS cnt_b FROM a JOIN b USING (kmer)")
def kmerdb_intersect(spark, d):
    return _text(kmerdb.intersect(_lib(spark, d, "rna_1"), _lib(spark, d, "rna_2")))


@query(f"WITH {_LIBS} SELECT coalesce(a.kmer, b.kmer) AS kmer, CASE WHEN b.kmer IS NULL THEN 'a' ELSE 'b' END AS side FROM a FULL JOIN b USING (kmer) WHERE a.kmer IS NULL OR b.kmer IS NULL")
def kmerdb_symdiff(spark, d):
    """#121: k-mers of one library only."""
    return _text(kmerdb.symmetric_difference(_lib(spark, d, "rna_1"), _lib(spark, d, "rna_2")))


@query(f"WITH {_LIBS} SELECT kmer FROM a WHERE kmer NOT IN (SELECT kmer FROM b)")
def kmerdb_missing(spark, d):
    """#80 negated: k-mers of one database that another does not have."""
    a, b = _lib(spark, d, "rna_1"), _lib(spark, d, "rna_2")
    return _text(a.join(b, "kmer", "left_anti").select("kmer"))


_HITS = "hits AS (SELECT kmer_id, count(*) AS cnt FROM kmer_hits WHERE kmer_id IS NOT NULL AND kmer_id <> -1 GROUP BY kmer_id)"


@query(f"WITH {_HITS} SELECT query_id, q.kmer_id, coalesce(cnt, 0) AS cnt, cnt IS NOT NULL AS found FROM kmer_queries q LEFT JOIN hits USING (kmer_id)")
def kmerdb_lookup(spark, d):
    """#80: count of each asked class id, 0 for unknown, invalid or null ones."""
    db = table(spark, d, "kmer_hits").where(S.is_id("kmer_id")).groupBy("kmer_id").agg(F.count(F.lit(1)).alias("cnt"))
    return kmerdb.look_up(table(spark, d, "kmer_queries").select("query_id", "kmer_id"), db, "kmer_id")


@query(f"WITH {_HITS} SELECT query_id, kmer_id FROM kmer_queries SEMI JOIN (SELECT kmer_id FROM hits WHERE cnt BETWEEN 2 AND 50) USING (kmer_id)")
def kmerdb_is_kmer(spark, d):
    """#65, #80: membership under narrowed thresholds 2 to 50."""
    db = table(spark, d, "kmer_hits").where(S.is_id("kmer_id")).groupBy("kmer_id").agg(F.count(F.lit(1)).alias("cnt"))
    return table(spark, d, "kmer_queries").select("query_id", "kmer_id").join(db.where(F.col("cnt").between(2, 50)), "kmer_id", "left_semi").select("query_id", "kmer_id")


@query(f"WITH {COUNTS} SELECT count(*) FILTER (cnt BETWEEN 3 AND 200) AS n_kmers, count(*) AS n_all FROM (SELECT least(cnt, 255) AS cnt FROM counts WHERE cnt >= 2)")
def kmerdb_range_count(spark, d):
    """#65, #89: k-mers under thresholds narrowed to 3 to 200, and all of the database."""
    ws = Workspace(spark, "kmerdb")
    kmerdb.save(K.cut_off(_counts(spark, d)), ws.where("db"), k=k_, ci=2, cx=10**9, cs=255)
    db = kmerdb.KmerDb(spark, ws.where("db"))
    db.narrow(3, 200)
    narrowed = db.count()
    db.reset()
    return narrowed.withColumnRenamed("n", "n_kmers").join(F.broadcast(db.count().withColumnRenamed("n", "n_all")))  # two single rows


@query(f"""WITH {COUNTS}, keyset AS (SELECT kmer FROM km WHERE lib_code = 'panel' GROUP BY kmer)
SELECT keyset.kmer, count(km.kmer) AS cnt FROM keyset LEFT JOIN (SELECT kmer FROM km WHERE lib_code = 'wgs_1') km ON km.kmer = keyset.kmer GROUP BY keyset.kmer""")
def kmer_prime_update(spark, d):
    """#92: prime with the k-mers of one library, count only those in another."""
    return _text(kmerdb.count_only(_lib(spark, d, "panel").select("kmer"), _lib(spark, d, "wgs_1")))


@query(f"WITH {COUNTS} SELECT kmer, cnt FROM counts WHERE kmer IN (SELECT kmer FROM km GROUP BY kmer HAVING count(*) >= 2)")
def kmer_bloom_filtered(spark, d):
    """#77: k-mers seen at least twice. The counts combined in each task stand for the Bloom counter, and are exact."""
    return _text(kmerdb.bloom_filtered(_reads(spark, d), "seq", k_))


@query(f"""WITH {reads()}, masked AS (SELECT read_id, lib_code, array_to_string(list_transform(generate_series(1, length(s)), lambda p:
  CASE WHEN (read_id * 31 + ((p - 1) // 30) * 7) % 41 < 10 THEN 'N' ELSE substr(s, p, 1) END), '') AS s FROM reads), {windows(k_, "masked")}, {canonical()}
SELECT kmer, count(*) AS cnt FROM km GROUP BY kmer""")
def kmer_min_quality(spark, d):
    """#78: bases below quality 10 act as N; the made-up qualities change every thirty bases."""
    r = _reads(spark, d).where("seq is not null").withColumn("s", S.squeeze("seq")).where("length(s) > 0")
    bases = F.split("s", "")
    q = F.transform(F.sequence(F.lit(0), F.length("s") - 1), lambda p: (F.col("read_id") * 31 + F.floor(p / 30) * 7) % 41)
    masked = r.select("read_id", F.array_join(F.zip_with(F.slice(bases, 1, F.length("s")), q, lambda b, x: F.when(x < 10, "N").otherwise(b)), "").alias("s"))
    return _text(K.count_kmers(masked, "s", k_))


@query(f"WITH {COUNTS} SELECT kmer, cnt FROM counts WHERE kmer NOT IN (repeat('A', {k_}), repeat('T', {k_}))")
def polya_discard(spark, d):
    """#67: without poly-A and poly-T k-mers (packed: 0 and the greatest value)."""
    return _text(_counts(spark, d).where(~F.col("kmer").isin(0, 4**k_ - 1)))


# -- scalar functions over whole columns


@query(rf"""SELECT read_id, reverse(translate(s, 'ACGT', 'TGCA')) AS rc, least(s, reverse(translate(s, 'ACGT', 'TGCA'))) AS canon,
translate(s, 'ACGTN', '01234') AS codes, right(s, 20) = left(s, 20) AS overlaps FROM (SELECT read_id, upper(regexp_replace(seq, '\s+', '', 'g')) AS s FROM read_seqs WHERE seq IS NOT NULL)""")
def revcomp(spark, d):
    """#33, #34, #35, #44: reverse complement, canonical form, base codes, and whether the ends overlap in k - 1 = 20 bases."""
    s = F.col("s")
    return (
        _reads(spark, d).where("seq is not null").select("read_id", S.squeeze("seq").alias("s"))
        .select("read_id", S.reverse_complement(s).alias("rc"), S.canonical(s).alias("canon"), F.translate(s, "ACGTN", "01234").alias("codes"), S.overlaps(s, s, 21).alias("overlaps"))
    )


@query(f"WITH {reads()}, {windows(4)}, {canonical()} SELECT w AS word, {code4('w', 4)}::BIGINT AS big, {code4('w', 4, True)}::BIGINT AS little FROM (SELECT DISTINCT w FROM win)")
def encode2bit(spark, d):
    """#33, #37, #40, #58: words of four bases as numbers, first base highest and first base lowest."""
    w = K.count_kmers(_reads(spark, d), "seq", 4, both_strands=False).select(K.spell("kmer", 4).alias("word"))
    return w.select("word", K.pack("word").alias("big"), K.pack(F.reverse("word")).alias("little"))


@query("SELECT q, CASE WHEN q <= 1 THEN 0.25 ELSE round(1 - power(10::DOUBLE, -q / 10::DOUBLE), 9) END::DOUBLE AS p_right, CASE WHEN q = 0 THEN NULL ELSE round(ln(1 - power(10::DOUBLE, -q / 10::DOUBLE)), 9) END AS log_p FROM (SELECT DISTINCT (read_id * 31) % 41 AS q FROM read_seqs)")
def phred_prob(spark, d):
    """#45, #46: phred quality to probability and log-probability."""
    q = _reads(spark, d).select(((F.col("read_id") * 31) % 41).alias("q")).distinct()
    return q.select("q", F.round(S.phred_probability("q"), 9).alias("p_right"), F.round(S.phred_log("q"), 9).alias("log_p"))


QUERIES, ORACLE = query.queries, query.oracle
