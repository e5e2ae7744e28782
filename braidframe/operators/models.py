"""Model operators: candidate grids, scoring and champions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidframe.operators.tabular import confusion, union_tagged


def fit_logistic(df: DataFrame, features: Sequence[str], label: str, *, weight_scale: float = 1.0, regularisation: float = 0.01, iterations: int = 30) -> PipelineModel:
    """Standardised logistic regression; positives weigh ``weight_scale`` times as much. Rows with a null feature or label are left out."""
    d = df.where(F.col(label).isNotNull()).na.drop(subset=list(features))
    d = d.select(*features, F.col(label).cast("double").alias("label"), F.when(F.col(label).cast("int") == 1, F.lit(float(weight_scale))).otherwise(1.0).alias("weight"))
    stages = [
        VectorAssembler(inputCols=list(features), outputCol="raw"),
        StandardScaler(inputCol="raw", outputCol="features", withMean=True),
        LogisticRegression(featuresCol="features", labelCol="label", weightCol="weight", regParam=regularisation, maxIter=iterations),
    ]
    return Pipeline(stages=stages).fit(d)


def score(model: PipelineModel, df: DataFrame, features: Sequence[str], threshold: float = 0.5) -> DataFrame:
    """Add ``probability`` and ``predicted``; rows with a null feature are left out."""
    scored = model.transform(df.na.drop(subset=list(features)))
    p = vector_to_array("probability").getItem(1)
    return scored.select(*df.columns, p.alias("probability")).withColumn("predicted", F.col("probability") >= threshold)


def grid(df: DataFrame, features: Sequence[str], label: str, candidates: Mapping[str, Mapping[str, float]]) -> DataFrame:
    """Metrics of each candidate: (candidate, tp, tn, fp, fn, accuracy, precision, recall, f1).

    Candidates are few and given by the caller; each is one distributed fit over all rows.
    """
    parts = {}
    for name, c in candidates.items():
        model = fit_logistic(df, features, label, weight_scale=c.get("weight_scale", 1.0), regularisation=c.get("regularisation", 0.01))
        scored = score(model, df.where(F.col(label).isNotNull()), features, c.get("threshold", 0.5))
        parts[name] = confusion(scored, F.col(label).cast("int") == 1, F.col("predicted"))
    return union_tagged(parts, "candidate")


def segment_means(scored: DataFrame, segment: str) -> DataFrame:
    """(segment, predicted_probability): mean probability by segment, three digits, greatest first; equal ones by name."""
    from braidframe.functions.parity import round_half_even

    means = scored.groupBy(segment).agg(F.avg("probability").alias("__mean"))
    return means.orderBy(F.desc("__mean"), segment).select(segment, round_half_even("__mean", 3).alias("predicted_probability"))


def champion(metrics: DataFrame, by: str = "f1", name: str = "candidate") -> DataFrame:
    """The row with the greatest metric; of equal ones the greater name."""
    return metrics.agg(F.max_by(F.struct(*metrics.columns), F.struct(by, name)).alias("r")).select("r.*")
