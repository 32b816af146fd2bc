"""Declarative policies over scored results.

Policies are configuration: a short table, checked for size, compiled to one expression per policy. Every
result is tested against all of them in one projection, so matching needs no join and no shuffle.
"""

from __future__ import annotations

import datetime as dt
import json
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewarden.functions.records import or_default
from tidewarden.session import broadcast_if_small

MAX_POLICIES = 1_000
BLOCK_SECONDS = 300

POLICY_SCHEMA = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("conditions", T.StringType()),  # JSON object: field -> value, list or {operator: value}
    T.StructField("actions", T.ArrayType(T.StringType())),
    T.StructField("priority", T.IntegerType()),
    T.StructField("ordinal", T.IntegerType()),
    T.StructField("enabled", T.BooleanType()),
    T.StructField("updated_at", T.TimestampType()),
])


@dataclass(frozen=True)
class Policy:
    name: str
    description: str
    conditions: dict[str, Any]
    actions: list[str]
    priority: int = 1
    enabled: bool = True
    updated_at: dt.datetime | None = field(default=None, compare=False)


# The five default policies.
DEFAULT_POLICIES = [
    Policy("high_risk_attack", "Block high-risk attacks immediately",
           {"prediction": "attack", "severity": "high", "risk_score": {"min": 0.8}}, ["block_ip", "alert"], 1),
    Policy("suspicious_activity", "Alert on suspicious activity",
           {"prediction": "suspicious", "severity": "medium", "risk_score": {"min": 0.6}}, ["alert", "monitor"], 2),
    Policy("anomaly_detection", "Alert on anomalies",
           {"is_anomaly": True, "anomaly_score": {"min": 0.7}}, ["alert"], 3),
    Policy("whitelist_override", "Allow whitelisted IPs", {"src_ip": {"in_whitelist": True}}, ["allow"], 0),
    Policy("blacklist_immediate", "Immediately block blacklisted IPs",
           {"src_ip": {"in_blacklist": True}}, ["block_ip", "alert"], 0),
]


def policy_table(spark: SparkSession, policies: list[Policy] = DEFAULT_POLICIES) -> DataFrame:
    rows = [
        (p.name, p.description, json.dumps(p.conditions), list(p.actions), p.priority, i, p.enabled, p.updated_at)
        for i, p in enumerate(policies)
    ]
    return spark.createDataFrame(rows, POLICY_SCHEMA)


def read_policies(table: DataFrame, at_most: int = MAX_POLICIES) -> list[Policy]:
    """A policy table in insertion order. It is configuration, so a long one is an error."""
    rows = table.orderBy("ordinal", "name").limit(at_most + 1).collect()
    if len(rows) > at_most:
        raise ValueError(f"more than {at_most} policies")
    return [
        Policy(r["name"], r["description"], json.loads(r["conditions"]), list(r["actions"]), r["priority"],
               r["enabled"], r["updated_at"])
        for r in rows
    ]


def add_policies(table: DataFrame, new: DataFrame, now: Column | None = None) -> DataFrame:
    """Add or replace by name. A replaced policy keeps its place; a new one goes to the end."""
    now = F.current_timestamp() if now is None else now
    place = table.select("name", F.col("ordinal").alias("_place"))
    end = table.agg(F.coalesce(F.max("ordinal") + 1, F.lit(0))).first()[0]
    stamped = (
        new.join(place, "name", "left")
        .withColumn("ordinal", F.coalesce("_place", F.col("ordinal") + end).cast("int"))
        .withColumn("updated_at", now)
    )
    return table.join(new, "name", "left_anti").unionByName(stamped.select(*table.columns))


def remove_policies(table: DataFrame, names: DataFrame) -> DataFrame:
    return table.join(names, "name", "left_anti")


def update_policies(table: DataFrame, changes: DataFrame, now: Column | None = None) -> DataFrame:
    """Set the non-NULL values of ``changes`` (by name); columns a policy does not have are ignored."""
    now = F.current_timestamp() if now is None else now
    known = [c for c in changes.columns if c in table.columns and c not in ("name", "updated_at")]
    renamed = changes.select("name", F.lit(True).alias("_hit"), *[F.col(c).alias(f"_{c}") for c in known])
    merged = table.join(renamed, "name", "left").withColumn(
        "updated_at", F.when(F.col("_hit"), now).otherwise(F.col("updated_at"))
    )
    return merged.select(*[
        F.coalesce(f"_{c}", c).cast(table.schema[c].dataType).alias(c) if c in known else F.col(c)
        for c in table.columns
    ])


def by_priority(policies: list[Policy]) -> list[Policy]:
    """Lower priority value first; equal priorities keep their insertion order."""
    return sorted(policies, key=lambda p: p.priority)


def _comparable(kind: T.DataType, value: Any) -> bool:
    if isinstance(value, str):
        return isinstance(kind, T.StringType)
    return isinstance(value, (bool, int, float)) and isinstance(kind, (T.NumericType, T.BooleanType))


def _operand(column: Column, kind: T.DataType, value: Any) -> tuple[Column, Column]:
    """Both sides on one type: booleans count as 0 and 1 when compared with numbers."""
    if isinstance(value, str) or (isinstance(value, bool) and isinstance(kind, T.BooleanType)):
        return column, F.lit(value)
    return column.cast("double"), F.lit(float(value))


def _compare(df: DataFrame, name: str, op: str, value: Any) -> Column:
    column, kind = F.col(name), df.schema[name].dataType
    if op == "in":
        hits = [_compare(df, name, "eq", v) for v in value]
        same = [v for v in value if isinstance(v, str)]
        if len(same) == len(value) and isinstance(kind, T.StringType):
            return column.isin(same)
        out = F.lit(False)
        for hit in hits:
            out = out | hit
        return out
    if not _comparable(kind, value):
        return F.lit(False)
    left, right = _operand(column, kind, value)
    if op == "eq":
        return left == right
    return left >= right if op == "min" else left <= right


def condition(df: DataFrame, name: str, expected: Any, placeholder: bool) -> Column:
    """One field's condition. A missing field, an unknown operator or unlike types never match.

    With ``placeholder`` the list conditions never match, as in the original rules; otherwise they test the
    membership flag that ``mark_lists`` adds.
    """
    if name not in df.columns:
        return F.lit(False)
    if isinstance(expected, list):
        return _compare(df, name, "in", expected)
    if not isinstance(expected, dict):
        return _compare(df, name, "eq", expected)
    holds = F.lit(True)
    for op, value in expected.items():
        if op in ("min", "max"):
            holds = holds & _compare(df, name, op, value)
        elif op in ("in_whitelist", "in_blacklist") and f"_{op}" in df.columns and not placeholder:
            holds = holds & (F.col(f"_{op}") == F.lit(bool(value)))
        else:
            return F.lit(False)
    return holds


def matches(df: DataFrame, policy: Policy, placeholder: bool = False) -> Column:
    holds = F.lit(True)
    for name, expected in policy.conditions.items():
        holds = holds & condition(df, name, expected, placeholder)
    return F.coalesce(holds, F.lit(False))


def ip_list(df: DataFrame, column: str = "ip") -> DataFrame:
    return df.select(F.col(column).alias("ip")).dropDuplicates()


def mark_lists(df: DataFrame, whitelist: DataFrame | None, blacklist: DataFrame | None) -> DataFrame:
    """Add ``_in_whitelist`` and ``_in_blacklist`` for the source address."""
    for name, listed in (("_in_whitelist", whitelist), ("_in_blacklist", blacklist)):
        if listed is None:
            df = df.withColumn(name, F.lit(False))
            continue
        flags = broadcast_if_small(ip_list(listed).select(F.col("ip").alias("src_ip"), F.lit(True).alias(name)))
        df = df.join(flags, "src_ip", "left").withColumn(name, F.coalesce(name, F.lit(False)))
    return df


def _decision(policy: Policy) -> Column:
    blocks = "block_ip" in policy.actions
    return F.struct(
        F.lit(policy.name).alias("policy_name"),
        F.lit(",".join(policy.actions)).alias("action"),
        F.lit(f"Policy {policy.name}: {policy.description}").alias("reason"),
        F.lit(blocks).alias("auto_block"),
        F.lit(BLOCK_SECONDS if blocks else 0).alias("block_duration"),
        F.lit(policy.priority > 1).alias("requires_approval"),
    )


def decide(
    results: DataFrame,
    policies: list[Policy] = DEFAULT_POLICIES,
    whitelist: DataFrame | None = None,
    blacklist: DataFrame | None = None,
    placeholder: bool = False,
    keep: tuple[str, ...] = ("result_id",),
) -> DataFrame:
    """One row per matching policy of each result, in priority order, ending with the first that allows."""
    marked = mark_lists(results, whitelist, blacklist) if not placeholder else results
    active = [p for p in by_priority(policies) if p.enabled]
    if not active:
        active = [Policy("none", "", {"": ""}, [])]
    hits = F.array_compact(F.array(*[F.when(matches(marked, p, placeholder), _decision(p)) for p in active]))
    matched = marked.withColumn("_hits", hits).filter(F.size("_hits") > 0)
    allow = F.array_position(F.transform("_hits", lambda d: F.contains(d["action"], F.lit("allow"))), True)
    upto = F.when(allow > 0, F.slice("_hits", F.lit(1), allow.cast("int"))).otherwise(F.col("_hits"))
    return (
        matched.select("*", F.posexplode(upto).alias("rank", "_d"))
        .select(
            *keep, "rank", "timestamp",
            or_default("src_ip", "unknown").alias("src_ip"), or_default("dst_ip", "unknown").alias("dst_ip"),
            "_d.policy_name", "_d.action", "_d.reason",
            or_default("severity", "low").alias("severity"), or_default("risk_score", 0.0).alias("risk_score"),
            "_d.auto_block", "_d.block_duration", "_d.requires_approval",
        )
    )
