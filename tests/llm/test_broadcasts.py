"""What is broadcast is counted: Spark takes rows exploded or read from a small file for far fewer than they are."""

from pyspark.sql import functions as F

from tidewarden.llm import components, simhash, similar
from tidewarden.session import BROADCAST_ROWS, materialize


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_anchors_of_many_fingerprints_are_not_broadcast(spark):
    """90,000 fingerprints, a file of about 1 MB, meet at more anchors than may be broadcast."""
    fp = F.xxhash64(F.col("id") % 45_000).bitwiseXOR(F.floor(F.col("id") / 45_000).cast("long"))
    distinct = materialize(spark.range(90_000).select(fp.alias("fp"), F.col("id").alias("first")))
    groups = simhash.split_groups(simhash._replicas(distinct), simhash.BLOCK)
    assert groups.select("anchor").distinct().count() > BROADCAST_ROWS
    assert "Broadcast" not in plan(groups) and "SortMergeJoin" in plan(groups)


def test_few_anchors_still_are(spark):
    distinct = materialize(spark.createDataFrame([(5, 1), (4, 2), (1 << 40, 3)], "fp long, first long"))
    assert "BroadcastHashJoin" in plan(simhash.split_groups(simhash._replicas(distinct), simhash.BLOCK))


def test_minima_of_many_nodes_and_named_components_are_not_broadcast(spark):
    rows = BROADCAST_ROWS + 20_000
    edges = materialize(spark.range(rows).select((F.col("id") * 2 + 1).alias("a"), (F.col("id") * 2).alias("b")))
    for half in (components._towards_smallest(edges), components._onto_smallest(edges)):
        assert "BroadcastHashJoin" not in plan(half)
    prints = materialize(spark.range(rows * 2).select(F.col("id").alias("doc_id"), F.col("id").alias("fp")))
    distinct = materialize(prints.select("fp", F.col("doc_id").alias("first")))
    named = simhash.named_components(prints, distinct, edges)
    assert "BroadcastHashJoin" not in plan(named)
    assert named.agg(F.count(F.lit(1)), F.sum(F.col("component_id") - F.col("doc_id") + F.col("doc_id") % 2)).first() == (rows * 2, 0)


def test_members_of_many_blocks_are_not_broadcast(spark):
    """2,000 members in 60 blocks each: the table is a file of a few KB, its rows are 120,000."""
    members = materialize(spark.range(2_000).select(F.lit(1).alias("anchor"), F.col("id").alias("fp"), F.col("id").alias("root")))
    sets = materialize(members.select("fp", F.unhex(F.lpad(F.hex("fp"), 16, "0")).alias("hashes")))
    parts = members.withColumn("part", F.explode(F.sequence(F.lit(1), F.lit(60))))
    assert "BroadcastHashJoin" not in plan(similar.checked(parts, sets, 0.8))
