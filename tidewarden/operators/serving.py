"""Trained models as scorers: functions from features to score columns."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewarden.operators.scoring import SEQUENCE_BLOCK, Scorer, anomaly_from_decision, sequence_blocks
from tidewarden.training.classifiers import class_probabilities
from tidewarden.training.isolation_forest import IsolationForestModel
from tidewarden.training.registry import label_of
from tidewarden.training.stages import DECISION


def classifier_scorer(model: PipelineModel) -> Scorer:
    """Adds ``_label`` and ``_confidence`` from a saved classifier pipeline."""
    def run(df: DataFrame) -> DataFrame:
        scored = model.transform(df)
        return scored.withColumns({
            "_label": label_of(model), "_confidence": F.array_max(class_probabilities(scored)),
        }).select(*df.columns, "_label", "_confidence")

    return run


def decision_scorer(model: PipelineModel) -> Scorer:
    """Adds ``_anomaly`` from a saved anomaly pipeline, whichever model is in it."""
    def run(df: DataFrame) -> DataFrame:
        return model.transform(df).withColumn("_anomaly", anomaly_from_decision(F.col(DECISION))).select(*df.columns, "_anomaly")

    return run


def forest_scorer(model: IsolationForestModel, vector: str = "vector") -> Scorer:
    """Adds ``_anomaly`` from an isolation forest."""
    return lambda df: df.withColumn("_anomaly", anomaly_from_decision(model.decision(F.col(vector))))


def sequence_scorer(score: Callable[[np.ndarray], np.ndarray], length: int, vector: str = "vector", block: int = SEQUENCE_BLOCK) -> Scorer:
    """Adds ``_sequence``: ``score`` maps a batch of shape (rows, length, entries) to one number per row.

    A block of a host's windows is one array; sequences are views that slide over it, so no vector is copied. Short
    histories are padded with zero vectors in front.
    """
    def slide(rows: pa.Table) -> pa.Table:
        order = np.argsort(rows.column("_pos").to_numpy())
        rows = rows.take(pa.array(order))
        flat = rows.column(vector).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float32)
        vectors = flat.reshape(len(rows), -1)
        padded = np.concatenate([np.zeros((length - 1, vectors.shape[1]), np.float32), vectors])
        views = np.lib.stride_tricks.sliding_window_view(padded, length, axis=0).transpose(0, 2, 1)
        own = np.flatnonzero(~rows.column("_copy").to_numpy())
        mine = views[len(rows) - len(own) :]  # copies come first; a block may hold nothing else
        found = np.asarray(score(mine), dtype=float).reshape(-1) if len(own) else np.zeros(0)
        return rows.take(pa.array(own)).drop_columns(["_pos", "_block", "_copy"]).append_column("_sequence", pa.array(found))

    def run(df: DataFrame) -> DataFrame:
        placed = sequence_blocks(df, length, block).select(*df.columns, "_pos", F.col("_in.block").alias("_block"), F.col("_in.copy").alias("_copy"))
        return placed.groupBy("src_ip", "_block").applyInArrow(slide, T.StructType([*df.schema.fields, T.StructField("_sequence", T.DoubleType())]))

    return run


def onnx_score(path: str) -> Callable[[np.ndarray], np.ndarray]:
    """A sequence score from an ONNX file that every executor can read; the session opens once per task."""
    session = None

    def score(block: np.ndarray) -> np.ndarray:
        nonlocal session
        if session is None:
            import onnxruntime

            session = onnxruntime.InferenceSession(path)
        return session.run(None, {session.get_inputs()[0].name: block})[0].reshape(len(block), -1)[:, 0]

    return score


def chain(*scorers: Scorer) -> Scorer:
    def run(df: DataFrame) -> DataFrame:
        for scorer in scorers:
            df = scorer(df)
        return df

    return run
