from pyspark.sql import functions as F

from seqloom.llm import queries as Q


def test_libraries_beyond_ten_thousand_are_counted(spark, tmp_path):
    params = spark.range(10_001).select(F.format_string("lib%05d", "id").alias("lib_code"), F.lit(5).alias("p_k"), F.lit(1).alias("p_ci"), F.lit(9).alias("p_cx"), F.lit(1).alias("p_cs"))
    params.write.parquet(f"{tmp_path}/count_params.parquet")
    rows = [(1, "ACGTTGC", "lib00000"), (2, "ACGTTGC", "lib10000"), (3, "ACGTTGC", "other"), (4, "ACGTTGC", None)]
    reads = spark.createDataFrame(rows, "read_id long, seq string, lib_code string").withColumns({c: F.lit(None).cast("timestamp") for c in ("run_at", "loaded_at")})
    reads.write.parquet(f"{tmp_path}/read_seqs.parquet")
    r = Q._Reads(spark, str(tmp_path))
    assert sorted(x.grp for x in r.reads.collect()) == [0, 10_000]
