"""Boosted trees as a ranker, held against the linear one on the same splits."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ml


@dataclass(frozen=True)
class Boosting:
    rounds: int = 30
    depth: int = 4
    rate: float = 0.1
    bins: int = 32
    least_rows: int = 5
    seed: int = 42


def _vectors(rows: DataFrame, features: list[str]) -> DataFrame:
    """rows with a vector of the features; missing and non-finite numbers are 0."""
    number = lambda f: F.col(f).cast("double")
    finite = lambda f: F.when(F.abs(number(f)) < F.lit(float("inf")), number(f)).otherwise(0.0)
    named = rows.select("*", *(F.coalesce(finite(f), F.lit(0.0)).alias(f"__{f}") for f in features))
    out = VectorAssembler(inputCols=[f"__{f}" for f in features], outputCol="__features").transform(named)
    return out.drop(*(f"__{f}" for f in features))


def fit(rows: DataFrame, features: list[str], label: str = "label", c: Boosting = Boosting()) -> GBTClassificationModel | None:
    """The model of the labelled rows; None unless both labels occur.

    Trees are grown by histograms that tasks add up, so the rows stay where they are; the model itself is small.
    """
    known = rows.where(F.col(label).isNotNull()).withColumn("__label", F.when(F.col(label) == 1, 1.0).otherwise(0.0))
    low, high = known.agg(F.min("__label"), F.max("__label")).first()
    if low is None or low == high:
        return None
    trees = GBTClassifier(
        featuresCol="__features", labelCol="__label", maxIter=c.rounds, maxDepth=c.depth, stepSize=c.rate, maxBins=c.bins,
        minInstancesPerNode=c.least_rows, seed=c.seed, predictionCol="__prediction")
    trees = trees.setProbabilityCol("__probability").setRawPredictionCol("__raw")
    return trees.fit(_vectors(known, features).select("__features", "__label"))


def scored(rows: DataFrame, features: list[str], model: GBTClassificationModel, name: str = "score") -> DataFrame:
    """rows with the probability of label 1, computed by the model's own columns, without Python."""
    made = model.transform(_vectors(rows, features))
    return made.withColumn(name, F.get(vector_to_array("__probability"), F.lit(1))).select(*rows.columns, name)


def importances(features: list[str], model: GBTClassificationModel) -> dict[str, float]:
    """The share of each feature in what the trees gain."""
    return {f: round(float(x), 6) for f, x in zip(features, model.featureImportances.toArray(), strict=True)}


def compared(rows: DataFrame, features: list[str], split: str, train: str, label: str = "label", c: Boosting = Boosting()) -> DataFrame:
    """Areas under the curve by split of both rankers, fitted on the rows of one split: model, split, positives, auc, ...

    Where the training rows lack a label there is no model and no row.
    """
    fitted = rows.where(F.col(split) == train)
    model = fit(fitted, features, label, c)
    if model is None:
        return rows.sparkSession.createDataFrame([], "model string, split string, positives long, negatives long, auc double")
    weights = ml.fit_linear(fitted, features, label).collect()  # a row for each feature
    linear = [r.asDict() for r in weights]
    both = scored(rows, features, model, "boosted").withColumn("linear", ml.linear_score(linear, linear[0]["intercept"]))
    out = None
    for name in ("boosted", "linear"):
        each = ml.auc(both, split, score=name, label=label).select(F.lit(name).alias("model"), F.col(split).alias("split"), "positives", "negatives", "auc")
        out = each if out is None else out.unionByName(each)
    return out
