"""Isolation forest (Liu, Ting, Zhou 2008) on Spark.

Each tree sees at most 256 rows, so growing is bounded work: the sample is drawn in parallel by hash, every tree
grows in its own group, and the finished forest (at most ``trees * (2 * sample - 1)`` nodes) is small enough
to go to every task. Scoring walks all trees over Arrow batches.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SEED = 42
TREES = 100
SAMPLE = 256
CONTAMINATION = 0.1
NODE_SCHEMA = "tree int, node int, feature int, threshold double, left int, right int, depth_value double"


def average_path(n: float) -> float:
    """Expected path length of an unsuccessful search among n rows."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + np.euler_gamma) - 2.0 * (n - 1.0) / n


def grow_tree(rows: np.ndarray, rng: np.random.Generator, depth_limit: int) -> list[tuple]:
    """Random splits down to single rows or the depth limit; a leaf carries its path length."""
    nodes: list[tuple] = []
    pending = [(np.arange(len(rows)), 0, -1, False)]
    while pending:
        members, depth, parent, is_right = pending.pop()
        number = len(nodes)
        if parent >= 0:
            nodes[parent][4 if is_right else 3] = number
        values = rows[members]
        low, high = values.min(axis=0), values.max(axis=0)
        splittable = np.flatnonzero(high > low)
        if depth >= depth_limit or len(splittable) == 0:
            nodes.append([number, -1, 0.0, -1, -1, depth + average_path(len(members))])
            continue
        feature = int(rng.choice(splittable))
        cut = float(rng.uniform(low[feature], high[feature]))
        nodes.append([number, feature, cut, -1, -1, 0.0])
        goes_right = values[:, feature] > cut
        pending.append((members[goes_right], depth + 1, number, True))
        pending.append((members[~goes_right], depth + 1, number, False))
    return [tuple(n) for n in nodes]


def unit_hash(*parts: Column) -> Column:
    """A reproducible number in [0, 1)."""
    return F.pmod(F.xxhash64(*parts), F.lit(2**30)) / F.lit(float(2**30))


def tree_samples(df: DataFrame, row_id: str, vector: str, trees: int, sample: int, seed: int) -> DataFrame:
    """(tree, rank, vector): at most ``sample`` rows per tree, drawn by hash of row and tree."""
    total = df.count()
    wanted = min(total, 4 * trees * sample)
    slim = df.select(row_id, F.col(vector).cast("array<double>").alias("v"))
    pool = slim.filter(unit_hash(F.lit(seed), F.col(row_id)) < wanted / max(total, 1))
    drawn = pool.select(row_id, "v", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"))
    ticket = unit_hash(F.lit(seed + 1), F.col("tree"), F.col(row_id))
    drawn = drawn.withColumn("ticket", ticket).filter(F.col("ticket") < min(1.0, 3.0 * sample / max(wanted, 1)))
    order = Window.partitionBy("tree").orderBy("ticket", row_id)
    return drawn.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= sample).select("tree", "rank", "v")


@dataclass
class IsolationForestModel:
    nodes: pd.DataFrame
    trees: int
    sample: int
    offset: float

    def score_samples(self, vector: Column) -> Column:
        """Minus the anomaly score of the paper, in [-1, 0]; lower is more anomalous."""
        grouped = [g.sort_values("node") for _, g in self.nodes.groupby("tree")]
        forest = [
            tuple(g[c].to_numpy() for c in ("feature", "threshold", "left", "right", "depth_value")) for g in grouped
        ]
        scale = average_path(self.sample)

        @F.pandas_udf("double")
        def walk(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for batch in batches:
                if batch.empty:
                    yield pd.Series([], dtype="float64")
                    continue
                rows = np.stack(batch.to_numpy()).astype(float)
                every = np.arange(len(rows))
                depth = np.zeros(len(rows))
                for feature, threshold, left, right, value in forest:
                    at = np.zeros(len(rows), dtype=int)
                    while True:
                        inner = feature[at] >= 0
                        if not inner.any():
                            break
                        goes_right = rows[every, np.maximum(feature[at], 0)] > threshold[at]
                        at = np.where(inner, np.where(goes_right, right[at], left[at]), at)
                    depth += value[at]
                yield pd.Series(-np.exp2(-(depth / len(forest)) / scale))

        return walk(vector.cast("array<double>"))

    def decision(self, vector: Column) -> Column:
        """Positive for inliers, negative for the ``contamination`` share of outliers in the training data."""
        return self.score_samples(vector) - F.lit(self.offset)

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame(self.nodes, NODE_SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{path}/nodes")
        meta = json.dumps({"trees": self.trees, "sample": self.sample, "offset": self.offset})
        spark.createDataFrame([(meta,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")

    @staticmethod
    def load(spark: SparkSession, path: str) -> IsolationForestModel:
        meta = json.loads(spark.read.text(f"{path}/meta").first()["value"])
        return IsolationForestModel(spark.read.parquet(f"{path}/nodes").toPandas(), **meta)


def fit_isolation_forest(
    df: DataFrame, row_id: str, vector: str = "vector", trees: int = TREES, sample: int = SAMPLE,
    contamination: float = CONTAMINATION, seed: int = SEED,
) -> IsolationForestModel:
    samples = tree_samples(df, row_id, vector, trees, sample, seed)

    def grow(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        tree = int(key[0])
        ordered = np.stack(rows.sort_values("rank")["v"].to_numpy())
        limit = math.ceil(math.log2(max(len(ordered), 2)))
        nodes = grow_tree(ordered, np.random.default_rng([seed, tree]), limit)
        return pd.DataFrame([(tree, *n) for n in nodes], columns=["tree", "node", "feature", "threshold", "left", "right", "depth_value"])

    nodes = samples.groupBy("tree").applyInPandas(grow, NODE_SCHEMA).toPandas()  # at most trees * (2 * sample - 1) rows
    size = min(sample, df.count())
    model = IsolationForestModel(nodes, trees, size, 0.0)
    scores = df.select(model.score_samples(F.col(vector)).alias("s"))
    model.offset = float(scores.agg(F.percentile_approx("s", contamination, 10_000)).first()[0])
    return model
