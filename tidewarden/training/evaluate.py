"""Accuracy and one-vs-rest area under the ROC curve."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewarden.operators.running import SLICE_ROWS, running_totals


def accuracy(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return df.agg(F.avg((F.col(label) == F.col(prediction)).cast("double")).alias("accuracy"))


def class_scores(df: DataFrame, label: str, probabilities: str | Column) -> DataFrame:
    """(class, score, positive) for every class of every row."""
    p = F.col(probabilities) if isinstance(probabilities, str) else probabilities
    return df.select(label, F.posexplode(p).alias("class", "score")).select(
        "class", F.col("score").cast("double").alias("score"), (F.col("class") == F.col(label)).cast("long").alias("positive")
    )


def class_auc(scores: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Exact AUC per class; equal scores count half.

    Rows are first counted per score, then ranked by running totals over slices of at most about ``slice_rows`` scores
    each, wherever the scores lie, so no task sees a whole class.
    """
    per_score = scores.groupBy("class", "score").agg(
        F.sum("positive").alias("pos"), (F.count(F.lit(1)) - F.sum("positive")).alias("neg")
    )
    ranked = running_totals(per_score, ["class"], ["score"], {"_below": F.col("neg")}, 1, slice_rows)
    wins = F.sum(F.col("pos") * (F.col("_below") - F.col("neg") + F.col("neg") / 2.0))
    return ranked.groupBy("class").agg(
        (wins / (F.sum("pos").cast("double") * F.sum("neg"))).alias("auc"), F.sum("pos").alias("positives")
    )


def mean_auc(df: DataFrame, label: str, probabilities: str | Column) -> DataFrame:
    """Macro mean over classes that occur; for two classes the second class alone, which is the same value."""
    return class_auc(class_scores(df, label, probabilities)).filter("positives > 0").agg(F.avg("auc").alias("auc_score"))
