"""Learned models by pyspark.ml: boosted trees out of fold and nested elastic nets.

The loops run over fits (folds, held-out groups), never over data; the training table is stored
once, as every fit reads it many times.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed


def classifier(rows: DataFrame, features: Sequence[str], label: str, depth: int = 6, trees: int = 100, seed: int = 0):
    """Boosted trees on a 0/1 label."""
    gather = VectorAssembler(inputCols=list(features), outputCol="_features", handleInvalid="keep")
    gbt = GBTClassifier(featuresCol="_features", labelCol=label, maxDepth=depth, maxIter=trees, seed=seed)
    return Pipeline(stages=[gather, gbt]).fit(rows)


def predicted(model, rows: DataFrame, name: str = "p") -> DataFrame:
    out = model.transform(rows).withColumn(name, vector_to_array("probability")[1])
    return out.drop("_features", "rawPrediction", "probability", "prediction")


def out_of_fold(rows: DataFrame, fold: str, folds: Sequence, features: Sequence[str], label: str,
                depth: int = 6, trees: int = 100, name: str = "p") -> DataFrame:
    """Each row predicted by the model that did not see its fold. With a group column as the fold
    these are the leave-one-group-out fits."""
    rows, parts = checkpointed(rows), None
    for k in folds:
        model = classifier(rows.filter(F.col(fold) != k), features, label, depth, trees)
        part = predicted(model, rows.filter(F.col(fold) == k), name)
        parts = part if parts is None else parts.unionByName(part)
    return parts


def elastic_net_out_of_fold(rows: DataFrame, inputs: Sequence[str], target: str, outer: str, folds: Sequence,
                            inner: str, inner_folds: int, strengths: Sequence[float],
                            mixes: Sequence[float], name: str = "prediction") -> DataFrame:
    """Penalised regression out of outer folds; strength and mix picked on inner folds of whole
    clusters, inputs rescaled on the training rows."""
    rows, parts = checkpointed(rows), None
    gather = VectorAssembler(inputCols=list(inputs), outputCol="_raw")
    scale = StandardScaler(inputCol="_raw", outputCol="_scaled", withMean=True)
    net = LinearRegression(featuresCol="_scaled", labelCol=target, predictionCol=name, standardization=False)
    grid = ParamGridBuilder().addGrid(net.regParam, list(strengths)).addGrid(net.elasticNetParam, list(mixes)).build()
    for k in folds:
        train = rows.filter(F.col(outer) != k)
        prep = Pipeline(stages=[gather, scale]).fit(train)
        search = CrossValidator(estimator=net, estimatorParamMaps=grid, numFolds=inner_folds, foldCol=inner,
                                evaluator=RegressionEvaluator(labelCol=target, predictionCol=name, metricName="mse"))
        best = search.fit(prep.transform(train))
        part = best.transform(prep.transform(rows.filter(F.col(outer) == k))).drop("_raw", "_scaled")
        parts = part if parts is None else parts.unionByName(part)
    return parts
