"""Bias correction: expression explained by sequence composition is taken out of it."""

from __future__ import annotations

from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def correct(expression: DataFrame, features: DataFrame, value: str, least: float = 1e-3, trees: int = 500, depth: int = 5, variance: float = 0.95, seed: int = 1) -> DataFrame:
    """(name, raw, corrected): ``value`` of rows of at least ``least`` is replaced by exp(mean + residual) of a forest that
    predicts ln(value) from the leading principal components of composition and ln length; other rows stay as they are.

    ``expression``: name, value; ``features``: name, length, gc and di_00..di_15. Targets without features are kept raw.
    """
    f = [c for c in features.columns if c.startswith("di_") or c == "gc"]
    x = expression.select("name", F.col(value).alias("raw")).join(features.select("name", F.log(F.greatest("length", F.lit(1))).alias("log_length"), *f), "name", "left")
    fit = x.where((F.col("raw") >= least) & F.col("log_length").isNotNull()).withColumn("y", F.log("raw"))
    if fit.isEmpty():
        return x.select("name", "raw", F.col("raw").alias("corrected"))
    fit = VectorAssembler(inputCols=["log_length", *f], outputCol="x").transform(fit)
    fit = StandardScaler(inputCol="x", outputCol="z", withMean=True).fit(fit).transform(fit)
    pca = PCA(k=len(f) + 1, inputCol="z", outputCol="components").fit(fit)
    kept, whole = 0, 0.0
    for share in pca.explainedVariance.toArray():
        kept, whole = kept + 1, whole + share
        if whole >= variance:
            break
    fit = PCA(k=kept, inputCol="z", outputCol="pc").fit(fit).transform(fit)
    fit = fit.withColumn("y", F.col("y"))
    model = RandomForestRegressor(featuresCol="pc", labelCol="y", numTrees=trees, maxDepth=depth, seed=seed).fit(fit)
    predicted = model.transform(fit)
    mean = fit.agg(F.avg("y").alias("m"))
    corrected = predicted.join(F.broadcast(mean)).select("name", F.exp(F.col("m") + F.col("y") - F.col("prediction")).alias("c"))
    return x.join(corrected, "name", "left").select("name", "raw", F.coalesce("c", "raw").alias("corrected"))
