"""Calibration of a logistic scorer, and measures of a ranking."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Calibrator:
    weights: dict[str, float]
    bias: float

    def score(self) -> Column:
        z = F.lit(self.bias)
        for name, w in self.weights.items():
            z = z + F.lit(w) * F.col(name)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))

    def to_config(self) -> dict:
        return {"weights": dict(self.weights), "bias": self.bias}

    @staticmethod
    def from_config(config: dict) -> Calibrator:
        return Calibrator({k: float(v) for k, v in config.get("weights", {}).items()}, float(config.get("bias", 0.0)))


def train(df: DataFrame, features: Sequence[str], label: str, c: float = 1.0, rounds: int = 200) -> Calibrator:
    """L2-penalised logistic regression with balanced classes; `c` is the inverse penalty on the sum of
    losses, so the penalty on their mean is 1 / (c n)."""
    n, positive = df.agg(F.count("*"), F.sum(label)).first()
    weight = F.when(F.col(label) == 1, F.lit(n / (2.0 * max(positive or 0, 1)))).otherwise(F.lit(n / (2.0 * max(n - (positive or 0), 1))))
    rows = VectorAssembler(inputCols=list(features), outputCol="x").transform(df.withColumn("w", weight).withColumn("y", F.col(label).cast("double")))
    model = LogisticRegression(featuresCol="x", labelCol="y", weightCol="w", regParam=1.0 / (c * max(n, 1)), standardization=False, maxIter=rounds).fit(rows)
    return Calibrator(dict(zip(features, map(float, model.coefficients), strict=True)), float(model.intercept))


def ranking_quality(df: DataFrame, score: str, label: str) -> DataFrame:
    """ROC AUC by rank sums (ties by half) and step-wise average precision. Rows meet by score value
    first, so the windows run over distinct scores."""
    groups = df.groupBy(score).agg(F.count("*").alias("c"), F.sum(label).alias("pos"))
    everything = Window.partitionBy()
    down, up = everything.orderBy(F.desc(score)), everything.orderBy(score)
    groups = groups.select("c", "pos", F.sum("c").over(down).alias("cn"), F.sum("pos").over(down).alias("cp"), (F.sum("c").over(up) - (F.col("c") - 1) / 2).alias("mid"))
    n, p = F.sum("c"), F.sum("pos")
    auc = (F.sum(F.col("mid") * F.col("pos")) - p * (p + 1) / 2) / (p * (n - p))
    return groups.agg(F.when((p > 0) & (p < n), auc).alias("roc_auc"), F.when(p > 0, F.sum(F.col("pos") * F.col("cp") / F.col("cn")) / p).alias("average_precision"))


def budget_threshold(df: DataFrame, score: str, budget: float) -> DataFrame:
    """(threshold, actual_rate): the (1 - budget) quantile of the scores and the share at or above it."""
    cut = df.agg(F.percentile(score, F.lit(1 - budget)).alias("threshold"))
    rows = df.groupBy(score).agg(F.count("*").alias("c"))
    return rows.join(cut, F.lit(True)).groupBy("threshold").agg((F.sum(F.when(F.col(score) >= F.col("threshold"), F.col("c")).otherwise(0)) / F.sum("c")).alias("actual_rate"))


def ablation(df: DataFrame, features: Sequence[str], label: str, dropped: str) -> DataFrame:
    """Average precision with and without a feature."""
    rest = [f for f in features if f != dropped]
    found = []
    for name, used in (("full", list(features)), (f"without_{dropped}", rest)):
        rows = df.select(F.round(train(df, used, label).score(), 6).alias("p"), F.col(label).alias("y"))
        found.append(ranking_quality(rows, "p", "y").select(F.lit(name).alias("model"), "roc_auc", "average_precision"))
    return found[0].unionByName(found[1])
