"""Application-layer statistics from HTTP and DNS logs; zero where a host has no such log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _count_map(df: DataFrame, keys: list[str], column: str, name: str) -> DataFrame:
    """Occurrences per value as a map; counted per value first, so a busy key sends few rows."""
    counted = df.filter(F.col(column).isNotNull()).groupBy(*keys, F.col(column).cast("string").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("v", "n"))).alias(name))


def http_features(log: DataFrame, keys: list[str]) -> DataFrame:
    """From requests (``keys``, method, uri, status, user_agent); a NULL status means no response was seen."""
    totals = log.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("request_count"),
        F.count("status").alias("response_count"),
        F.coalesce(F.avg(F.length("uri")), F.lit(0.0)).alias("avg_uri_length"),
        F.count_distinct("user_agent").alias("unique_user_agents"),
    )
    empty = F.create_map().cast("map<string,bigint>")
    return (
        totals.join(_count_map(log, keys, "status", "status_codes"), keys, "left")
        .join(_count_map(log, keys, "method", "methods"), keys, "left")
        .withColumns({c: F.coalesce(c, empty) for c in ("status_codes", "methods")})
    )


def dns_features(log: DataFrame, keys: list[str]) -> DataFrame:
    """From queries (``keys``, query, qtype, rcode); a NULL rcode means no answer was seen."""
    totals = log.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("query_count"),
        F.count("rcode").alias("response_count"),
        (F.count_if(F.col("rcode") == "NXDOMAIN") / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("nxdomain_ratio"),
        F.coalesce(F.avg(F.length("query")), F.lit(0.0)).alias("avg_domain_length"),
        F.count_distinct("query").alias("unique_domains"),
    )
    empty = F.create_map().cast("map<string,bigint>")
    return totals.join(_count_map(log, keys, "qtype", "query_types"), keys, "left").withColumn(
        "query_types", F.coalesce("query_types", empty)
    )
