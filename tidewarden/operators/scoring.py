"""Model outputs to one verdict per flow window."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewarden.functions.records import clamp01, or_default
from tidewarden.operators.running import running_totals

# Score thresholds, all strict.
ANOMALY_THRESHOLD = 0.8
ATTACK_THRESHOLD = 0.7
SEQUENCE_THRESHOLD = 0.6
HIGH_RISK = 0.8
MEDIUM_RISK = 0.6

HOUR = 3_600_000_000
# Rows of one host that are handled together when its sequences are built.
SEQUENCE_BLOCK = 4096

Scorer = Callable[[DataFrame], DataFrame]


def anomaly_from_decision(decision: Column) -> Column:
    """Isolation-forest decision value (positive is inlying) to a 0..1 anomaly score."""
    return clamp01(F.lit(0.5) - decision)


def anomaly_result(score: str | None, threshold: float = ANOMALY_THRESHOLD, model: str = "isolation_forest") -> Column:
    """Without a model the score is 0 and nothing is anomalous."""
    value = F.coalesce(F.col(score), F.lit(0.0)) if score else F.lit(0.0)
    return F.struct(
        value.alias("anomaly_score"), (value > threshold).alias("is_anomaly"),
        F.lit(model if score else None).cast("string").alias("model_name"),
        F.lit(threshold if score else None).cast("double").alias("threshold"),
    )


def best_class(probabilities: str | Column) -> Column:
    """0-based index of the most probable class; the first of equals."""
    p = F.col(probabilities) if isinstance(probabilities, str) else probabilities
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def classification_result(
    label: str | None, confidence: str | None, threshold: float = ATTACK_THRESHOLD,
    benign: tuple[str, ...] = ("normal",), model: str = "random_forest",
) -> Column:
    """Any label outside ``benign`` is an attack if its confidence exceeds the threshold."""
    value = F.coalesce(F.col(confidence), F.lit(0.0)) if confidence else F.lit(0.0)
    attack = ~F.coalesce(F.col(label), F.lit(benign[0])).isin(*benign) if label else F.lit(False)
    return F.struct(
        F.when(attack, "attack").otherwise("normal").alias("prediction"), value.alias("confidence"),
        (attack & (value > threshold)).alias("is_attack"),
        F.lit(model if label else None).cast("string").alias("model_name"),
        F.lit(threshold if label else None).cast("double").alias("threshold"),
    )


def sequence_result(score: str | None, threshold: float = SEQUENCE_THRESHOLD, model: str = "lstm_anomaly") -> Column:
    value = F.coalesce(F.col(score), F.lit(0.0)) if score else F.lit(0.0)
    return F.struct(
        value.alias("sequence_anomaly_score"), (value > threshold).alias("is_sequence_anomaly"),
        F.lit(model if score else None).cast("string").alias("model_name"),
        F.lit(threshold if score else None).cast("double").alias("threshold"),
    )


def fuse(df: DataFrame) -> DataFrame:
    """``anomaly``, ``classification`` and ``sequence`` structs to the published result columns.

    The published anomaly score is the forest's own; the risk uses the larger of forest and sequence.
    """
    is_anomaly = F.coalesce(F.col("anomaly.is_anomaly"), F.lit(False)) | F.coalesce(
        F.col("sequence.is_sequence_anomaly"), F.lit(False)
    )
    is_attack = F.coalesce(F.col("classification.is_attack"), F.lit(False))
    combined = F.greatest("anomaly.anomaly_score", "sequence.sequence_anomaly_score")
    risk = F.greatest(
        F.lit(0.0), F.when(is_attack, F.col("classification.confidence")), F.when(is_anomaly, combined)
    )
    attack = is_attack & (F.col("risk_score") > HIGH_RISK)
    suspicious = is_anomaly & (F.col("risk_score") > MEDIUM_RISK)
    return (
        df.withColumns({
            "src_ip": or_default("src_ip", "unknown"),
            "dst_ip": or_default("dst_ip", "unknown"),
            "is_anomaly": is_anomaly,
            "is_attack": is_attack,
            "risk_score": risk,
            "anomaly_score": F.col("anomaly.anomaly_score"),
            "sequence_anomaly_score": F.col("sequence.sequence_anomaly_score"),
            "classification_confidence": F.col("classification.confidence"),
            "model_results": F.struct("anomaly", "classification", "sequence"),
        })
        .withColumns({
            "prediction": F.when(attack, "attack").when(suspicious, "suspicious").otherwise("normal"),
            "severity": F.when(attack, "high").when(suspicious, "medium").otherwise("low"),
        })
        .drop("anomaly", "classification", "sequence")
    )


def processing_delay(ts: str = "timestamp", now: Column | None = None) -> Column:
    """Seconds from the event to ``now``, the time of the query if none is given."""
    return (F.unix_micros(F.current_timestamp() if now is None else now) - F.unix_micros(ts)) / F.lit(1e6)


def result_counts(results: DataFrame) -> DataFrame:
    return results.agg(
        F.count(F.lit(1)).alias("inferences_processed"),
        F.count_if(F.col("anomaly_score") > ANOMALY_THRESHOLD).alias("anomalies_detected"),
        F.count_if(F.col("prediction") == "attack").alias("attacks_classified"),
    )


def traffic_rule(df: DataFrame) -> DataFrame:
    """Score columns from byte volume and resets, for use before any model is trained."""
    volume = F.col("byte_count").cast("double")
    resets = F.coalesce(F.try_element_at("tcp_flags", F.lit("RST")), F.lit(0)) > 0
    return df.withColumns({
        "_anomaly": F.least(F.lit(1.0), volume / 50000.0),
        "_confidence": F.when(resets, F.least(F.lit(1.0), 0.75 + volume / 100000.0)).otherwise(F.lit(0.5)),
        "_label": F.when(resets, "attack").otherwise("normal"),
    })


def score(features: DataFrame, scorer: Scorer = traffic_rule) -> DataFrame:
    """Run a scorer (adds ``_anomaly``, ``_confidence``, ``_label``, optionally ``_sequence``) and fuse."""
    scored = scorer(features)
    have = set(scored.columns)
    named = lambda c: c if c in have else None
    return fuse(scored.withColumns({
        "anomaly": anomaly_result(named("_anomaly")),
        "classification": classification_result(named("_label"), named("_confidence")),
        "sequence": sequence_result(named("_sequence")),
    })).drop("_anomaly", "_confidence", "_label", "_sequence")


def host_sequences(df: DataFrame, length: int, vector: str = "vector", block: int = SEQUENCE_BLOCK) -> DataFrame:
    """Add each window's own vector and up to ``length - 1`` earlier ones of its host, oldest first."""
    placed = sequence_blocks(df, length, block)
    ordered = Window.partitionBy("src_ip", "_in.block").orderBy("_pos").rowsBetween(1 - length, 0)
    return placed.withColumn("sequence", F.collect_list(vector).over(ordered)).filter("not _in.copy").drop("_in", "_pos")


def sequence_blocks(df: DataFrame, length: int, block: int = SEQUENCE_BLOCK) -> DataFrame:
    """Rows with their number ``_pos`` in their host's history and ``_in``, the block they are in and whether as a copy.

    A host's windows are numbered and cut into blocks of ``block`` rows; the last ``length - 1`` rows of a block
    are copied into the next one, so a busy host is spread over many tasks and no history is lost. A block is never
    shorter than a sequence.
    """
    block = max(block, length)
    numbered = running_totals(df, ["src_ip"], ["window_at", "window_id"], {"_pos": F.lit(1)}, HOUR)
    place = F.floor((F.col("_pos") - 1) / block)
    reaches_on = (F.col("_pos") - 1) % block >= block - (length - 1)
    own = F.struct(place.alias("block"), F.lit(False).alias("copy"))
    ahead = F.when(reaches_on, F.struct((place + 1).alias("block"), F.lit(True).alias("copy")))
    return numbered.select("*", F.explode(F.array_compact(F.array(own, ahead))).alias("_in"))


def mean_shift(sequence: str = "sequence", entry: int = 2) -> Column:
    """A plain sequence score: how far the last value of one entry lies above the sequence's mean, in 0..1."""
    values = F.transform(F.col(sequence), lambda v: F.get(v, F.lit(entry)).cast("double"))
    total = F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)
    last = F.element_at(values, -1)
    return F.when(total > 0, clamp01(last / total)).otherwise(F.lit(0.0)) * (F.size(values) > 1).cast("double")
