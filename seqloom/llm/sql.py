"""DuckDB SQL of the queries that SQL can express over whole tables."""

WS = r"regexp_replace({0}, '\s+', '', 'g')"
_KEYED = r"""
keyed AS (SELECT read_id, s, least(s, reverse(translate(s, 'ACGT', 'TGCA'))) AS read_key
  FROM (SELECT read_id, upper(regexp_replace(seq, '\s+', '', 'g')) AS s FROM read_seqs) WHERE regexp_matches(s, '[ACGT]'))"""

_KMERS = r"""
params AS (SELECT lib_code, p_k, coalesce(p_ci, 2) AS ci, coalesce(p_cx, 1000000000) AS cx FROM count_params),
s AS (SELECT read_id, lib_code, p_k, upper(regexp_replace(seq, '\s+', '', 'g')) AS s FROM read_seqs JOIN params USING (lib_code)),
w AS (SELECT read_id, lib_code, substr(s, p, p_k) AS w FROM (
  SELECT read_id, lib_code, p_k, s, unnest(generate_series(1, length(s) - p_k + 1)) AS p FROM s)),
k AS (SELECT read_id, lib_code, least(w, reverse(translate(w, 'ACGT', 'TGCA'))) AS kmer FROM w WHERE NOT regexp_matches(w, '[^ACGT]')),
counts AS (SELECT lib_code, kmer, count(*) AS n_occ, count(DISTINCT read_id) AS n_reads FROM k GROUP BY ALL),
marked AS (SELECT lib_code, kmer, n_occ, n_reads, CASE WHEN n_reads < ci THEN 'rare' WHEN n_occ > cx THEN 'common' END AS mark
  FROM counts JOIN params USING (lib_code))"""

_GROUPS = r"""
m AS (SELECT DISTINCT 'k' || kmer_id AS g, transcript_id AS t FROM kmer_hits
  WHERE kmer_id <> -1 AND transcript_id IS NOT NULL AND kmer_id NOT IN (SELECT kmer_id FROM promiscuous_classes WHERE kmer_id IS NOT NULL)
  UNION SELECT DISTINCT 'g' || gene_id, transcript_id FROM transcripts WHERE gene_id <> 0),
e AS (SELECT DISTINCT t AS a, min(t) OVER (PARTITION BY g) AS b FROM m),
links AS (SELECT a, b FROM e WHERE a <> b UNION SELECT b, a FROM e WHERE a <> b),
reach(t, r) AS (SELECT DISTINCT a, a FROM links UNION SELECT links.b, reach.r FROM reach JOIN links ON links.a = reach.t WHERE reach.r < links.b)"""

_SPANS = r"""
w AS (SELECT transcript_id, p, kmers[p + 1 : p + 32] AS w FROM (
  SELECT transcript_id, kmers, unnest(generate_series(0, len(kmers) - 32)) AS p FROM (SELECT DISTINCT transcript_id, kmers FROM transcripts WHERE len(kmers) >= 32))),
ok AS (SELECT transcript_id, p, w FROM w WHERE NOT list_contains(w, -1) AND list_count(w) = 32),
shared AS (SELECT w FROM ok GROUP BY w HAVING min(transcript_id) < max(transcript_id)),
hit AS (SELECT DISTINCT transcript_id, p FROM ok SEMI JOIN shared USING (w)),
marked AS (SELECT transcript_id, p, coalesce((p > lag(p) OVER t + 32)::INT, 0) AS new FROM hit WINDOW t AS (PARTITION BY transcript_id ORDER BY p)),
isl AS (SELECT transcript_id, p, sum(new) OVER (PARTITION BY transcript_id ORDER BY p) AS island FROM marked),
spans AS (SELECT transcript_id, min(p)::BIGINT AS span_start, (max(p) + 31)::BIGINT AS span_end FROM isl GROUP BY transcript_id, island)"""

ORACLE = {
    "p1_found": f"""
WITH {_KEYED}
SELECT 'read_seqs.seq' AS field, read_id AS rec_id FROM keyed
WHERE read_id > (SELECT min(k2.read_id) FROM keyed k2 WHERE k2.read_key = keyed.read_key)
UNION ALL
SELECT 'kmer_queries.kmer_id', query_id FROM kmer_queries q
WHERE kmer_id <> -1 AND EXISTS (SELECT 1 FROM kmer_hits h WHERE h.kmer_id = q.kmer_id AND h.loaded_at < q.asked_at)""",
    "p1_report": f"""
WITH {_KEYED}
SELECT 'read_seqs.seq' AS field, count(DISTINCT read_key) AS n_keys, 0::BIGINT AS n_false_hits, 0::DOUBLE AS wrong_rate FROM keyed
UNION ALL
SELECT 'kmer_queries.kmer_id', count(DISTINCT kmer_id), 0, 0 FROM kmer_hits WHERE kmer_id <> -1""",
    "p2_found": f"WITH {_KMERS} SELECT lib_code, kmer, mark FROM marked WHERE mark IS NOT NULL",
    "p2_counts": f"WITH {_KMERS} SELECT lib_code, kmer, n_occ, n_reads, mark FROM marked",
    "p2_update": f"WITH {_KMERS} SELECT lib_code, kmer, n_occ, n_reads, mark FROM marked",
    "p5_found": f"""
WITH {_KEYED}
(SELECT 'read_seqs.seq' AS field, read_key AS item_key FROM keyed GROUP BY read_key ORDER BY count(*) DESC, read_key LIMIT 10)
UNION ALL
(SELECT 'kmer_hits.kmer_id', kmer_id::VARCHAR FROM kmer_hits WHERE kmer_id <> -1 GROUP BY kmer_id ORDER BY count(*) DESC, kmer_id::VARCHAR LIMIT 10)""",
    "p5_report": f"""
WITH {_KEYED}
SELECT field, item_key, n_rows, n_rows > 0 AS guaranteed FROM (
(SELECT 'read_seqs.seq' AS field, read_key AS item_key, count(*) AS n_rows FROM keyed GROUP BY read_key ORDER BY n_rows DESC, read_key LIMIT 10)
UNION ALL
(SELECT 'kmer_hits.kmer_id', kmer_id::VARCHAR, count(*) AS n_rows FROM kmer_hits WHERE kmer_id <> -1 GROUP BY kmer_id ORDER BY n_rows DESC, kmer_id::VARCHAR LIMIT 10))""",
    "p6_found": f"""
WITH RECURSIVE {_GROUPS}
SELECT t AS transcript_id, min(r) AS group_id FROM reach GROUP BY t""",
    "p7_found": f"WITH {_SPANS} SELECT transcript_id, span_start, span_end FROM spans",
    "p7_report": f"""
WITH {_SPANS},
n AS (SELECT transcript_id, sum(span_end - span_start + 1)::BIGINT AS n_shared, count(*) AS n_spans FROM spans GROUP BY transcript_id),
z AS (SELECT transcript_id, max(coalesce(len(kmers), 0))::BIGINT AS n_kmers, max(length) AS length FROM transcripts GROUP BY transcript_id)
SELECT transcript_id, n_kmers, coalesce(n_spans, 0) AS n_spans, coalesce(n_shared, 0) AS n_shared,
  CASE WHEN n_kmers > 0 THEN round(coalesce(n_shared, 0) / n_kmers, 6) ELSE 0.0 END::DOUBLE AS shared_share,
  round(CASE WHEN n_kmers > 0 THEN round(coalesce(n_shared, 0) / n_kmers, 6) ELSE 0.0 END::DOUBLE * length, 2) AS shared_length
FROM z LEFT JOIN n USING (transcript_id)""",
}
