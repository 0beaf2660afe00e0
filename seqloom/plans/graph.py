"""Queries of the de Bruijn graph of all reads."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dbg
from ..operators import kmers as K
from .counting import COUNTS, RC, k_
from .registry import Registry
from .workspace import Workspace, table

query = Registry()

_ENDS = f"""{COUNTS}, ends AS MATERIALIZED (SELECT node, e, y, {RC.format('y')} AS back FROM (SELECT kmer AS node, 'R' AS e, substr(kmer, 2) AS y FROM counts
  UNION ALL SELECT kmer, 'L', {RC.format(f'substr(kmer, 1, {k_ - 1})')} FROM counts)),
edges AS MATERIALIZED (SELECT a.node AS src, a.e AS src_end, b.node AS dst, b.e AS dst_end, a.y < a.back AS first FROM ends a JOIN ends b ON b.y = a.back),
deg AS (SELECT src AS node, src_end AS e, count(*) AS n FROM edges GROUP BY ALL)"""


def _kmers(spark, d):
    k = K.count_kmers(table(spark, d, "read_seqs"), "seq", k_).select("kmer")
    return Workspace(spark, "graph").write(k, "kmers")


def _text(df, *columns):
    for c in columns:
        df = df.withColumn(c, K.spell(c, k_))
    return df


@query(f"WITH {_ENDS} SELECT src, src_end, dst, dst_end FROM edges")
def dbg_edges(spark, d):
    """#85: edges between the ends of k-mers."""
    return _text(dbg.edges(_kmers(spark, d), "kmer", k_), "src", "dst")


@query(f"""WITH {_ENDS} SELECT node, coalesce(sum(n) FILTER (e = 'L'), 0)::BIGINT AS deg_l, coalesce(sum(n) FILTER (e = 'R'), 0)::BIGINT AS deg_r
FROM (SELECT node, e, n FROM deg UNION ALL SELECT kmer, 'L', 0 FROM counts) GROUP BY node""")
def dbg_degree(spark, d):
    """#124: degrees of both ends."""
    return _text(dbg.degrees(_kmers(spark, d), "kmer", k_), "node")


@query(f"""WITH {_ENDS} SELECT src AS a, src_end AS a_end, dst AS b, dst_end AS b_end FROM edges JOIN deg x ON x.node = src AND x.e = src_end JOIN deg y ON y.node = dst AND y.e = dst_end
WHERE x.n = 1 AND y.n = 1 AND src <> dst AND first""")
def dbg_mergeable(spark, d):
    """#124: pairs of ends that can be merged."""
    return _text(dbg.mergeable(_kmers(spark, d), "kmer", k_), "a", "b")


@query()
def unitigs(spark, d):
    """#22, #125, #126: maximal non-branching paths."""
    return dbg.unitigs(_kmers(spark, d), "kmer", k_)


@query(f"WITH {COUNTS} SELECT kmer, 1::BIGINT AS n FROM counts")
def unitig_kmers(spark, d):
    """#121, #125: the k-mers of the unitigs are those of the reads, each exactly once."""
    u = dbg.unitigs(_kmers(spark, d), "kmer", k_)
    return _text(K.count_kmers(u, "unitig", k_), "kmer").withColumnRenamed("cnt", "n")


@query(f"WITH {COUNTS} SELECT count(*) AS n_kmers FROM counts")
def graph_size(spark, d):
    """#104: bases of all unitigs less the overlaps, which is the number of k-mers."""
    return dbg.unitigs(_kmers(spark, d), "kmer", k_).agg(F.sum(F.length("unitig") - (k_ - 1)).alias("n_kmers"))


QUERIES, ORACLE = query.queries, query.oracle
