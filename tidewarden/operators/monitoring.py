"""Operating metrics: labelled counters, the latency histogram, gauges, rates and host alerts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewarden.functions.records import or_default

# Counter of each event type, its labels and their defaults.
COUNTERS = {
    "packet_processed": ("ids_packets_processed_total", {"source": "unknown", "protocol": "unknown"}),
    "feature_extracted": ("ids_features_extracted_total", {"feature_type": "unknown"}),
    "inference_completed": ("ids_inferences_completed_total", {"model_name": "unknown", "prediction": "unknown"}),
    "anomaly_detected": ("ids_anomalies_detected_total", {"severity": "low"}),
    "attack_classified": ("ids_attacks_classified_total", {"attack_type": "unknown", "severity": "low"}),
    "block_executed": ("ids_blocks_executed_total", {"policy_name": "unknown", "reason": "unknown"}),
    "alert_generated": ("ids_alerts_generated_total", {"severity": "low", "policy_name": "unknown"}),
    "error_occurred": ("ids_errors_total", {"component": "unknown", "error_type": "unknown"}),
}
# Histogram bounds in seconds.
LATENCY_BOUNDS = [0.001, 0.005, 0.01, 0.05, 0.1, 0.5, 1.0, 5.0]
# Host readings with their alert and critical limits.
HOST_LIMITS = [
    ("high_cpu", "cpu_percent", 80.0, 90.0),
    ("high_memory", "memory_percent", 85.0, 95.0),
    ("high_disk", "disk_usage_percent", 90.0, 95.0),
    ("high_load", "load_average[0]", 4.0, 8.0),
]
SECOND = 1_000_000


def route(events: DataFrame) -> DataFrame:
    """Counter and label values of each event that has a counter."""
    metric, names, values = (F.lit(None).cast(t) for t in ("string", "array<string>", "array<string>"))
    for kind, (counter, labels) in COUNTERS.items():
        hit = F.col("type") == kind
        metric = F.when(hit, F.lit(counter)).otherwise(metric)
        names = F.when(hit, F.array(*[F.lit(n) for n in labels])).otherwise(names)
        values = F.when(hit, F.array(*[or_default(n, d) for n, d in labels.items()])).otherwise(values)
    return events.filter(F.col("type").isin(*COUNTERS)).withColumns(
        {"metric": metric, "label_names": names, "label_values": values}
    )


def counters(events: DataFrame) -> DataFrame:
    """Counter values per metric and labels; counted on the map side, so a hot label set is no bottleneck."""
    return (
        route(events).groupBy("metric", "label_names", "label_values").agg(F.count(F.lit(1)).alias("value"))
        .select("metric", F.map_from_arrays("label_names", "label_values").alias("labels"), "value")
    )


def latency_histogram(events: DataFrame) -> DataFrame:
    """Cumulative buckets, sum and count per component and operation, in one pass over the events."""
    timed = events.filter("type = 'processing_latency'").select(
        or_default("component", "unknown").alias("component"), or_default("operation", "unknown").alias("operation"),
        or_default("latency", 0.0).alias("latency"),
    )
    counted = timed.groupBy("component", "operation").agg(
        *[F.count_if(F.col("latency") <= b).alias(f"_b{i}") for i, b in enumerate(LATENCY_BOUNDS)],
        F.count(F.lit(1)).alias("observations"),
        F.sum("latency").alias("latency_sum"),
    )
    buckets = [F.struct(F.lit(str(b)).alias("le"), F.col(f"_b{i}").alias("cumulative")) for i, b in enumerate(LATENCY_BOUNDS)]
    buckets.append(F.struct(F.lit("+Inf").alias("le"), F.col("observations").alias("cumulative")))
    return counted.select("component", "operation", "latency_sum", "observations", F.inline(F.array(*buckets)))


def gauges(readings: DataFrame) -> DataFrame:
    """Latest value per (name, label); rows are (name, label, value, at, id)."""
    return readings.groupBy("name", "label").agg(F.max_by("value", F.struct("at", "id")).alias("value"))


def events_by_type(events: DataFrame) -> DataFrame:
    return events.groupBy(or_default("type", "unknown").alias("type")).agg(F.count(F.lit(1)).alias("events"))


def latest(df: DataFrame, order: list[str], limit: int) -> DataFrame:
    """The newest rows over all; Spark keeps only ``limit`` rows per task."""
    return df.orderBy(*[F.col(c).desc() for c in order]).limit(limit)


def minute_rates(events: DataFrame, now: int, order: list[str], last: int = 100, window: int = 60) -> DataFrame:
    """Of the newest ``last`` events: how many per type, and how many within ``window`` seconds of ``now``."""
    recent = F.unix_micros("timestamp") > now - window * SECOND
    return (
        latest(events, order, last)
        .groupBy(or_default("type", "unknown").alias("type"))
        .agg(F.count(F.lit(1)).alias("events"), F.count_if(recent & F.col("type").isNotNull()).alias("per_minute"))
    )


def sliding_rates(events: DataFrame, window: str = "60 seconds", every: str = "30 seconds") -> DataFrame:
    return events.groupBy(F.window("timestamp", window, every).alias("span"), or_default("type", "unknown").alias("type")).agg(
        F.count(F.lit(1)).alias("events")
    )


def summary_counts(events: DataFrame, now: int, seconds: int = 300) -> DataFrame:
    return events_by_type(events.filter(F.unix_micros("timestamp") > now - seconds * SECOND))


def metrics_summary(events: DataFrame, readings: DataFrame, now: int, seconds: int = 300) -> DataFrame:
    """Events per type of the last ``seconds``, each row with their total and the newest host reading (two one-row sides)."""
    counts = summary_counts(events, now, seconds)
    total = counts.agg(F.coalesce(F.sum("events"), F.lit(0)).alias("total_events"))
    return counts.join(F.broadcast(total), how="cross").join(F.broadcast(latest_host(readings)), how="cross")


def latest_host(readings: DataFrame) -> DataFrame:
    """The newest host reading in one row, zeros when there is none."""
    zero_load = F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0))
    picked = F.max_by(F.struct("cpu_percent", "memory_percent", "disk_usage_percent", "load_average"), F.struct("timestamp", "id"))
    return readings.agg(picked.alias("r")).select(
        *[or_default(f"r.{c}", 0.0).alias(c) for c in ("cpu_percent", "memory_percent", "disk_usage_percent")],
        F.coalesce("r.load_average", zero_load).alias("load_average"),
    )


def alert_message(kind: Column, value: Column, threshold: Column) -> Column:
    return F.concat(
        F.lit("System alert: "), kind, F.lit(" is "), value.cast("string"), F.lit(" (threshold: "),
        threshold.cast("string"), F.lit(")"),
    )


def host_alerts(readings: DataFrame) -> DataFrame:
    """Up to four alerts per host reading."""
    found = F.array(*[
        F.when(F.expr(column) > warn, F.struct(
            F.lit(kind).alias("type"),
            F.when(F.expr(column) < critical, "warning").otherwise("critical").alias("severity"),
            F.expr(column).alias("value"), F.lit(warn).alias("threshold"),
        ))
        for kind, column, warn, critical in HOST_LIMITS
    ])
    alerts = readings.select("id", "timestamp", F.inline(F.array_compact(found)))
    return alerts.withColumn("message", alert_message(F.col("type"), F.col("value"), F.col("threshold")))


def custom_metric(points: DataFrame) -> DataFrame:
    """Metric points (name, value, labels, timestamp) as metric events."""
    return points.select(
        F.lit("custom_metric").alias("type"), "name", F.col("value").cast("double").alias("value"),
        F.coalesce("labels", F.create_map().cast("map<string,string>")).alias("labels"), "timestamp",
    )


def stage_statistics(output: DataFrame, rejects: DataFrame, now: int, at: str) -> DataFrame:
    """Totals, errors, uptime and rate of one stage from what it wrote; uptime runs from its first row."""
    done = output.select(F.lit(1).alias("ok"), F.lit(0).alias("bad"), F.col(at).alias("at"))
    bad = rejects.select(F.lit(0).alias("ok"), F.lit(1).alias("bad"), F.lit(None).cast("long").alias("at"))
    totals = done.unionByName(bad).agg(
        F.coalesce(F.sum("ok"), F.lit(0)).alias("processed"), F.coalesce(F.sum("bad"), F.lit(0)).alias("errors"),
        F.coalesce((F.lit(now) - F.min("at")) / F.lit(float(SECOND)), F.lit(0.0)).alias("uptime_seconds"),
    )
    return with_rate(totals)


def stages_statistics(stages: dict[str, tuple[DataFrame, DataFrame | None, str]], now: int) -> DataFrame:
    """``stage_statistics`` of several stages, one row each: what a stage wrote, what it rejected, its time column."""
    rows = []
    for stage, (output, rejects, at) in stages.items():
        none = output.sparkSession.createDataFrame([], "nothing int")
        found = stage_statistics(output, none if rejects is None else rejects, now, at)
        rows.append(found.withColumn("stage", F.lit(stage)))
    return reduce(DataFrame.unionByName, rows)


def with_rate(totals: DataFrame) -> DataFrame:
    """Rows a second over the uptime."""
    rate = F.when(F.col("uptime_seconds") > 0, F.col("processed") / F.col("uptime_seconds")).otherwise(F.lit(0.0))
    return totals.withColumn("per_second", rate)
