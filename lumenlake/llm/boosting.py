"""Boosted trees with isotonic calibration, over a column of dense features."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Boosted:
    """Gradient-boosted trees fitted on two thirds of the rows, their probability calibrated on all of them.

    ``rows`` has doc_id, label (0 or 1) and features (array of doubles). With one class only, every score is that
    class; without rows it is 0.
    """

    def __init__(self, rows: DataFrame, trees: int = 20, depth: int = 3, seed: int = 7):
        n, ones = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0))).first()
        self.constant = None if 0 < ones < n else float(n > 0 and ones == n)
        if self.constant is not None:
            return
        ready = rows.select("label", array_to_vector("features").alias("vector"), (F.pmod(F.xxhash64("doc_id"), F.lit(3)) > 0).alias("fit"))
        fit = ready.where("fit")
        if fit.agg(F.countDistinct("label")).first()[0] < 2:
            fit = ready
        self.trees = GBTClassifier(
            featuresCol="vector", labelCol="label", maxIter=trees, maxDepth=depth, stepSize=0.3, seed=seed, minInstancesPerNode=2
        ).fit(fit)
        raw = self._raw(ready.withColumn("weight", F.when(F.col("fit"), 0.25).otherwise(1.0)))
        self.curve = IsotonicRegression(featuresCol="raw", labelCol="label", weightCol="weight", predictionCol="score").fit(raw)

    def _raw(self, rows: DataFrame) -> DataFrame:
        return self.trees.transform(rows).withColumn("raw", vector_to_array("probability")[1])

    def score(self, rows: DataFrame, keep: list[str]) -> DataFrame:
        """The kept columns and the calibrated ``score`` between 0 and 1."""
        if self.constant is not None:
            return rows.select(*keep, F.lit(self.constant).alias("score"))
        raw = self._raw(rows.withColumn("vector", array_to_vector("features")))
        scored = self.curve.transform(raw)
        return scored.select(*keep, F.least(F.lit(1.0), F.greatest(F.lit(0.0), "score")).alias("score"))
