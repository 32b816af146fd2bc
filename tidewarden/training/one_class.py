"""One-class boundary at scale: random Fourier features (Rahimi, Recht 2007) with a linear one-class objective.

The kernel machine it replaces needs all pairs of rows. Here each step is one pass that sums, per task, the
features of the rows on the wrong side; only those sums travel.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SEED = 42
NU = 0.1


@dataclass
class OneClassModel:
    frequencies: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    threshold: float

    def margin(self, vector: Column) -> Column:
        frequencies, phases, weights = self.frequencies, self.phases, self.weights

        @F.pandas_udf("double")
        def project(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for batch in batches:
                rows = np.stack(batch.to_numpy()) if len(batch) else np.zeros((0, frequencies.shape[0]))
                yield pd.Series(fourier(rows, frequencies, phases) @ weights)

        return project(vector.cast("array<double>"))

    def decision(self, vector: Column) -> Column:
        """Positive inside the boundary."""
        return self.margin(vector) - F.lit(self.threshold)

    def save(self, spark: SparkSession, path: str) -> None:
        """One row: the boundary is as large as its features, whatever it was fitted on."""
        parts = {n: getattr(self, n).tolist() for n in ("frequencies", "phases", "weights")}
        text = json.dumps({**parts, "threshold": self.threshold})
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> OneClassModel:
        parts = json.loads(spark.read.text(path).first()["value"])
        return OneClassModel(*[np.array(parts[n]) for n in ("frequencies", "phases", "weights")], parts["threshold"])


def fourier(rows: np.ndarray, frequencies: np.ndarray, phases: np.ndarray) -> np.ndarray:
    return np.sqrt(2.0 / len(phases)) * np.cos(rows @ frequencies + phases)


def fit_one_class(
    df: DataFrame, vector: str, width: int, nu: float = NU, gamma: float | None = None, features: int = 64,
    steps: int = 15, rate: float = 0.5, seed: int = SEED,
) -> OneClassModel:
    """``width`` is the vector's length; vectors are expected scaled, so ``gamma`` defaults to 1 / width."""
    rng = np.random.default_rng(seed)
    gamma = 1.0 / width if gamma is None else gamma
    model = OneClassModel(
        rng.normal(0.0, np.sqrt(2.0 * gamma), (width, features)), rng.uniform(0.0, 2.0 * np.pi, features),
        np.zeros(features), 0.0,
    )
    slim = df.select(F.col(vector).cast("array<double>").alias("v"))
    for step in range(steps):
        count, outside, total = _pass(slim, model)
        step_rate = rate / np.sqrt(step + 1.0)
        model.weights = model.weights - step_rate * (model.weights - total / (nu * max(count, 1)))
        model.threshold = model.threshold + step_rate * (1.0 - outside / (nu * max(count, 1)))
    model.threshold = float(slim.select(model.margin(F.col("v")).alias("m")).agg(F.percentile_approx("m", nu, 10_000)).first()[0])
    return model


def _pass(slim: DataFrame, model: OneClassModel) -> tuple[int, int, np.ndarray]:
    """Rows, rows at or below the threshold, and the feature sum of the latter."""
    frequencies, phases, weights, threshold = model.frequencies, model.phases, model.weights, model.threshold
    width = len(phases)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, outside, total = 0, 0, np.zeros(width)
        for batch in batches:
            if not batch.num_rows:
                continue
            # The vectors lie one after the other in the batch: no object is made of any of them.
            z = fourier(batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1), frequencies, phases)
            wrong = z @ weights <= threshold
            count, outside, total = count + len(z), outside + int(wrong.sum()), total + z[wrong].sum(axis=0)
        values = pa.array([float(count), float(outside), *total.tolist()], pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array(range(width + 2), pa.int32()), values], names=["entry", "value"])

    added = slim.mapInArrow(sums, "entry int, value double").groupBy("entry").agg(F.sum("value").alias("value"))
    values = {r["entry"]: r["value"] for r in added.collect()}  # one row per entry of the sum
    return int(values[0]), int(values[1]), np.array([values[i + 2] for i in range(width)])
