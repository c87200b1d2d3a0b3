"""Boosted trees that predict a target directly; histograms and splits are Spark ML's, so only the trees reach the driver."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame

ROUNDS, DEPTH, RATE, BINS, LEAST, SEED = 40, 3, 0.1, 64, 8, 22


@dataclass
class DirectTrees:
    """A fitted model; predictions need the features by name, and rows with a null feature are refused."""

    model: PipelineModel

    @classmethod
    def fit(cls, rows: DataFrame, features: list[str], target: str) -> DirectTrees:
        known = rows.select(*features, target).dropna()
        assembled = VectorAssembler(inputCols=features, outputCol="_features", handleInvalid="error")
        trees = GBTRegressor(featuresCol="_features", labelCol=target, predictionCol="_made", maxIter=ROUNDS, maxDepth=DEPTH, stepSize=RATE, maxBins=BINS, minInstancesPerNode=LEAST, seed=SEED)
        return cls(PipelineModel([assembled, trees.fit(assembled.transform(known))]))

    def predict(self, rows: DataFrame, name: str) -> DataFrame:
        return self.model.transform(rows).withColumnRenamed("_made", name).drop("_features")

    def save(self, path: str) -> None:
        self.model.write().save(path)

    @classmethod
    def load(cls, path: str) -> DirectTrees:
        return cls(PipelineModel.load(path))
