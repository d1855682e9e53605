"""Pair models on Spark ML: boosted trees, a linear model, their ensemble, and constants where a slice has one class."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .features import FEATURES

ENSEMBLE_WEIGHT = 0.75


@dataclass(frozen=True)
class ModelSpec:
    name: str = "trees"
    kind: str = "gbt"  # gbt, linear or ensemble
    positive_weight: float | None = None  # None: as is; 0: balanced
    variation: bool = False
    rounds: int = 40
    depth: int = 5
    step: float = 0.1


def clean(rows: DataFrame) -> DataFrame:
    """Features without NaN, infinities or nulls."""
    def finite(c: str) -> Column:
        x = F.col(c).cast("double")
        return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x)

    return rows.withColumns({c: finite(c) for c in FEATURES})


@dataclass
class PairModel:
    """probability of a pair by its features; ``parts``: fitted pipelines and their weights, or a constant."""

    parts: list
    constant: float = 0.0

    def predict(self, rows: DataFrame) -> DataFrame:
        """Adds probability, from 0 to 1."""
        if not self.parts:
            return rows.withColumn("probability", F.lit(self.constant))
        out, total = clean(rows), F.lit(0.0)
        for k, (model, weight) in enumerate(self.parts):
            out = model.transform(out).withColumn(f"_p{k}", vector_to_array("probability")[1]).drop("_x", "_s", "rawPrediction", "probability", "prediction")
            total = total + weight * F.col(f"_p{k}")
        out = out.withColumn("probability", F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)))
        return out.drop(*[f"_p{k}" for k in range(len(self.parts))])


def fit(rows: DataFrame, spec: ModelSpec = ModelSpec(), seed: int = 42) -> PairModel:
    """Trains on FEATURES and label. A slice with no rows gives 0, one with a single class that class."""
    n, pos = rows.agg(F.count("*"), F.coalesce(F.sum(F.col("label").cast("long")), F.lit(0))).first()
    if n == 0 or pos in (0, n):
        return PairModel([], 0.0 if n == 0 else float(pos > 0))
    weight = (n - pos) / pos if spec.positive_weight == 0 else spec.positive_weight or 1.0
    data = clean(rows).withColumn("_w", F.when(F.col("label") == 1, float(weight)).otherwise(1.0)).withColumn("_y", F.col("label").cast("double"))
    assemble = VectorAssembler(inputCols=FEATURES, outputCol="_x")
    trees = Pipeline(stages=[assemble, GBTClassifier(featuresCol="_x", labelCol="_y", weightCol="_w", maxIter=spec.rounds, maxDepth=spec.depth, stepSize=spec.step, subsamplingRate=0.85, minInfoGain=0.0, seed=seed)])
    linear = Pipeline(stages=[assemble, StandardScaler(inputCol="_x", outputCol="_s", withMean=True), LogisticRegression(featuresCol="_s", labelCol="_y", weightCol="_w", maxIter=500, regParam=1.0 / n)])
    if spec.kind == "gbt":
        return PairModel([(trees.fit(data), 1.0)])
    if spec.kind == "linear":
        return PairModel([(linear.fit(data), 1.0)])
    return PairModel([(trees.fit(data), ENSEMBLE_WEIGHT), (linear.fit(data), 1 - ENSEMBLE_WEIGHT)])


def predict_pairs(rows: DataFrame, threshold: float = 0.5) -> DataFrame:
    """source1_id and its matched target_ids, sorted, by a threshold."""
    return rows.where(F.col("probability") >= threshold).groupBy("source1_id").agg(F.array_sort(F.collect_set("target_id")).alias("matched"))


def specs(imbalance: float) -> list[ModelSpec]:
    """The grid that tuning tries: four base models, and three with learned variation."""
    moderate = min(imbalance, max(1.25, imbalance**0.5))
    base = [ModelSpec("trees"), ModelSpec("trees_moderate", positive_weight=moderate), ModelSpec("trees_balanced", positive_weight=0), ModelSpec("ensemble", "ensemble", moderate)]
    return base + [ModelSpec(f"{s.name}_variation", s.kind, s.positive_weight, True) for s in (base[0], base[1], base[3])]
