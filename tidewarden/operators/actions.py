"""What decisions lead to: actions, alerts, the watch list, the audit log and block intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewarden.operators.anchored import HOT_ROWS, anchored_starts
from tidewarden.operators.chained import BLOCK_ROWS
from tidewarden.operators.policies import BLOCK_SECONDS, ip_list
from tidewarden.operators.running import running_totals, totals_between
from tidewarden.session import broadcast_if_small, materialize

# The actions that are carried out; others are ignored.
ACTIONS = ("block_ip", "alert", "monitor", "allow")
HOUR = 3_600_000_000


def skip_whitelisted(decisions: DataFrame, whitelist: DataFrame | None) -> DataFrame:
    """Decisions that may act. The decision log keeps the others too."""
    if whitelist is None:
        return decisions
    listed = broadcast_if_small(ip_list(whitelist).withColumnRenamed("ip", "src_ip"))
    return decisions.join(listed, "src_ip", "left_anti")


def explode_actions(decisions: DataFrame, whitelist: DataFrame | None = None) -> DataFrame:
    """One row per action to carry out, in ``act``; ``step`` is its place in the decision."""
    acting = skip_whitelisted(decisions, whitelist)
    steps = acting.select("*", F.posexplode(F.split("action", ",")).alias("step", "act"))
    return steps.withColumn("act", F.trim("act")).filter(F.col("act").isin(*ACTIONS))


def alerts(actions: DataFrame, keep: tuple[str, ...] = ("result_id",)) -> DataFrame:
    return actions.filter("act = 'alert'").select(
        *keep, "timestamp", "src_ip", "dst_ip", "policy_name", "action", "severity", "risk_score", "reason"
    )


def watch_list(actions: DataFrame) -> DataFrame:
    return actions.filter("act = 'monitor'").groupBy("src_ip").agg(
        F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"), F.count(F.lit(1)).alias("times")
    )


def decision_counts(decisions: DataFrame) -> DataFrame:
    """By the text of the action; whitelisted sources count too."""
    return decisions.agg(
        F.count(F.lit(1)).alias("decisions"),
        F.count_if(F.contains("action", F.lit("block_ip"))).alias("blocks_executed"),
        F.count_if(F.contains("action", F.lit("alert"))).alias("alerts_sent"),
    )


def block_intervals(
    actions: DataFrame, seconds: int = BLOCK_SECONDS, hot_rows: int = HOT_ROWS, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Block intervals per source: an attempt blocks only if no block is active then.

    A block ends after ``seconds`` (at that moment it no longer holds) or at the next allow. The attempts
    between two allows form an episode of their own, inside which blocks are anchored windows, of which only the first
    attempt is looked for. The acts are written once, as a slim table, because episodes, hot addresses and allows each read them.
    """
    at = F.unix_micros("timestamp")
    acts = materialize(actions.filter(F.col("act").isin("block_ip", "allow")).select(
        F.col("src_ip").alias("ip"), at.alias("at"), F.struct("result_id", "rank", "step").alias("id"),
        "act", "reason", "policy_name", "severity",
    ))
    counted = running_totals(acts, ["ip"], ["at", "id"], {"episode": (F.col("act") == "allow").cast("int")}, HOUR)
    attempts = counted.filter("act = 'block_ip'").drop("act")
    opened = anchored_starts(attempts, ["ip", "episode"], "at", "id", seconds * 1_000_000 - 1, None, hot_rows, block_rows)
    lifted = counted.filter("act = 'allow'").select(
        "ip", (F.col("episode") - 1).alias("episode"), F.col("at").alias("lifted_at")
    )
    expires = F.col("at") + F.lit(seconds * 1_000_000)
    return opened.join(lifted, ["ip", "episode"], "left").select(
        "ip", "reason", "policy_name", "severity",
        F.col("at").alias("blocked_at"),
        expires.alias("expires_at"),
        F.least(expires, "lifted_at").alias("ended_at"),
        F.col("id.result_id").alias("result_id"),
        F.lit(True).alias("auto_unblock"),
    )


def active_blocks(blocks: DataFrame, at: int) -> DataFrame:
    """Blocks that hold at one moment (microseconds)."""
    return blocks.filter((F.col("blocked_at") <= at) & (F.col("ended_at") > at))


def blocked_at_time(rows: DataFrame, blocks: DataFrame, row_id: list[str], slice_width: int = HOUR) -> DataFrame:
    """For rows (ip, *row_id, until): whether the address was blocked then.

    Blocks of one address never overlap, so it is blocked exactly if more of them have begun than ended.
    """
    edges = blocks.select(
        "ip", F.explode(F.array(
            F.struct(F.col("blocked_at").alias("at"), F.lit(1).alias("held")),
            F.struct(F.col("ended_at").alias("at"), F.lit(-1).alias("held")),
        )).alias("e")
    ).select("ip", "e.at", "e.held")
    asked = rows.select("ip", *row_id, F.col("until").alias("since"), "until")
    held = totals_between(edges, asked, ["ip"], row_id, {"held": F.col("held")}, slice_width, since_start=("held",))
    return held.select("ip", *row_id, (F.col("held") > 0).alias("is_blocked"))


def remove_keys(df: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return df.join(gone.select(key).dropDuplicates(), key, "left_anti")


def attack_audit(decisions: DataFrame) -> DataFrame:
    return decisions.select(
        F.lit("attack_detected").alias("event_type"), "timestamp", F.col("policy_name").alias("attack_type"),
        F.col("src_ip").alias("source_ip"), F.col("dst_ip").alias("target_ip"),
        F.col("risk_score").alias("confidence"), F.struct("action", "severity", "reason").alias("details"),
    )


def block_audit(blocks: DataFrame, seconds: int = BLOCK_SECONDS) -> DataFrame:
    return blocks.select(
        F.lit("block_action").alias("event_type"), F.timestamp_micros("blocked_at").alias("timestamp"),
        F.lit("block").alias("action"), "ip", "reason", F.lit(seconds).alias("duration"),
    )


def false_positive_audit(reports: DataFrame) -> DataFrame:
    return reports.select(F.lit("false_positive").alias("event_type"), "timestamp", "alert_id", "analyst", "reason")


def model_update_audit(updates: DataFrame) -> DataFrame:
    return updates.select(F.lit("model_update").alias("event_type"), "timestamp", "model_name", "version", "performance")


def audit_log(*parts: DataFrame) -> DataFrame:
    """One table of all audit events; fields an event lacks are NULL."""
    log, *others = parts
    for part in others:
        log = log.unionByName(part, allowMissingColumns=True)
    return log
