"""Tree ensembles on tables: forests and boosting, for numbers and for classes, with their metrics, importances and files.

Trees are grown by pyspark.ml, level by level over the whole table: a split is chosen from histograms of the features, which are
added up from all tasks, so neither rows nor candidate splits are ever in one place. There are no out-of-bag scores, as rows are
weighted, not left out, while trees are grown; :func:`fit` holds a share of the rows back instead.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_KINDS = {("forest", False): RandomForestRegressor, ("forest", True): RandomForestClassifier, ("boosting", False): GBTRegressor, ("boosting", True): GBTClassifier}


def fit(df: DataFrame, features: list[str], label: str, kind: str = "forest", classes: bool = False, trees: int = 500, depth: int = 5, impurity: str | None = None, held_back: float = 0.0, seed: int = 1) -> tuple[PipelineModel, dict[str, float]]:
    """(model, metrics on the rows held back) of a forest or of boosting.

    ``classes``: the label is a class number from 0 (two classes for boosting) instead of a number. ``impurity``: gini or entropy for
    forests of classes, variance otherwise. Rows with a null label or a null or NaN feature are left out. ``held_back``: share of the
    rows, chosen by a hash, that metrics are taken on; with 0 there are none.
    """
    if (kind, classes) not in _KINDS:
        raise ValueError(f"no such kind: {kind}")
    rows = df.select(*(F.col(f).cast("double").alias(f) for f in features), F.col(label).cast("double").alias("__label")).na.drop()
    out = F.pmod(F.xxhash64(F.lit(seed), *features, "__label"), F.lit(1_000_000)) < int(held_back * 1_000_000)
    learner = _KINDS[kind, classes](featuresCol="__x", labelCol="__label", predictionCol="prediction", maxDepth=depth, seed=seed)
    learner = learner.setNumTrees(trees) if kind == "forest" else learner.setMaxIter(trees)
    if impurity:
        learner = learner.setImpurity(impurity)
    model = Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="__x"), learner]).fit(rows.where(~out))
    if not held_back:
        return model, {}
    y, p = F.col("__label"), F.col("prediction")
    metrics = {"accuracy": accuracy(y, p)} if classes else {"rmse": F.sqrt(F.avg((y - p) * (y - p))), "r2": squared_correlation(y, p)}
    return model, model.transform(rows.where(out)).agg(*(c.alias(n) for n, c in metrics.items())).first().asDict()


def importances(model: PipelineModel, features: list[str]) -> dict[str, float]:
    """Share of each feature in the gain of all splits; one number a feature."""
    return dict(zip(features, model.stages[-1].featureImportances.toArray().tolist()))


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def accuracy(y: Column, prediction: Column) -> Column:
    """Share of rows whose label is the predicted one."""
    return F.avg((y == prediction).cast("int"))


def binomial_deviance(y: Column, score: Column) -> Column:
    """Mean of y f - ln(1 + exp(f)) of labels 0 or 1 and scores f on the scale of log odds."""
    return F.avg(y * score - F.log1p(F.exp(score)))


def squared_correlation(y: Column, prediction: Column) -> Column:
    """1 where nothing varies and nothing is missed, 0 where only one of the two varies."""
    return F.when((F.var_pop(y) == 0) | (F.var_pop(prediction) == 0), F.when(F.covar_pop(y, prediction) == 0, 1.0).otherwise(0.0)).otherwise(F.pow(F.corr(y, prediction), F.lit(2)))
