"""Ball-control models with class weights on pyspark.ml."""

from __future__ import annotations

from pyspark.ml import PipelineModel, Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F


def weighted(rows: DataFrame, label: str = "y") -> DataFrame:
    """Weight of each row so that both classes weigh the same."""
    share = rows.agg(F.avg(label).alias("_pos"))
    return rows.crossJoin(F.broadcast(share)).withColumn("weight", F.when(F.col(label) == 1, 0.5 / F.nullif(F.col("_pos"), F.lit(0.0))).otherwise(
        0.5 / F.nullif(F.lit(1.0) - F.col("_pos"), F.lit(0.0)))).drop("_pos")


def fit_control(rows: DataFrame, features: list[str], kind: str = "logistic", label: str = "y") -> PipelineModel:
    """Logistic regression, or boosted trees of depth 3 in 60 rounds at most."""
    model = (LogisticRegression(labelCol=label, weightCol="weight", maxIter=200, regParam=0.001) if kind == "logistic"
             else GBTClassifier(labelCol=label, weightCol="weight", maxDepth=3, maxIter=60, minInstancesPerNode=15, seed=42))
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep"), model]).fit(weighted(rows, label))


def control_probability(model: PipelineModel, rows: DataFrame) -> DataFrame:
    return model.transform(rows).withColumn("p", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")
