"""The detection path as one plan: records, windows, features, scores, decisions, actions, blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewarden.operators.flows import WINDOW_RECORDS, WINDOW_US, flow_features
from tidewarden.operators.policies import DEFAULT_POLICIES, Policy, decide
from tidewarden.operators.scoring import Scorer, score, traffic_rule


def score_flows(
    records: DataFrame, width: int = WINDOW_US, cap: int | None = WINDOW_RECORDS, scorer: Scorer = traffic_rule
) -> DataFrame:
    """Flow records to one scored result per flow window; ``result_id`` is the window's first record."""
    return score(flow_features(records, width, cap), scorer).withColumn("result_id", F.col("window_id"))


def detect(
    records: DataFrame,
    width: int = WINDOW_US,
    cap: int | None = WINDOW_RECORDS,
    scorer: Scorer = traffic_rule,
    policies: list[Policy] = DEFAULT_POLICIES,
    whitelist: DataFrame | None = None,
    blacklist: DataFrame | None = None,
) -> DataFrame:
    """Flow records to policy decisions."""
    return decide(score_flows(records, width, cap, scorer), policies, whitelist, blacklist)


def decisions_of_events(spark: SparkSession, folder: str) -> DataFrame:
    """The flagship query: decisions on the flow records derived from ``events``, in 24 h windows."""
    from tidewarden.catalog.tables import CAP, WIDTH, flows

    return detect(flows(spark, folder), WIDTH, CAP)
