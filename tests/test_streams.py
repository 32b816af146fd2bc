"""Streams in several micro-batches give what the batch operators give."""

import time

from pyspark.sql import functions as F

from tidewarden.catalog.decisions import BLOCK_SECONDS, acts, blocks
from tidewarden.catalog.flows import windowed
from tidewarden.catalog.tables import DAY, flows
from tidewarden.session import run_dir
from tidewarden.streaming.runner import STORES_PER_CORE, drain, few_stores
from tidewarden.operators.hosts import distinct_so_far, trailing_totals
from tidewarden.streaming.state import due_ms, stream_blocks, stream_flow_windows, stream_host_context
from helpers import records

HOUR_US = 3_600_000_000


def in_files(spark, df, at, parts=4):
    """Files in time order, one per micro-batch."""
    path = run_dir(spark, "parts")
    low, high = df.agg(F.min(at), F.max(at)).first()
    step = (high - low) // parts + 1
    for i in range(parts):
        df.filter((F.col(at) >= low + i * step) & (F.col(at) < low + (i + 1) * step)).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path), high // 1000 - HOUR_US // 1000


def test_flow_windows_in_micro_batches(spark, folder):
    f = flows(spark, folder).withColumn("us", F.unix_micros("ts"))
    stream, mark = in_files(spark, f, "us")
    got = drain(stream_flow_windows(stream.drop("us"), DAY, 2, "1 hour"))
    got = {(r["record_id"], r["window_id"]) for r in got.collect()}
    batch = windowed(spark, folder, DAY, 2).collect()
    closed = {(r["record_id"], r["window_id"]) for r in batch if due_ms(r["window_at"] + DAY) <= mark}
    assert closed <= got <= {(r["record_id"], r["window_id"]) for r in batch}


def test_blocks_in_micro_batches(spark, folder):
    a = acts(spark, folder).filter("act in ('block_ip', 'allow')").withColumn("us", F.unix_micros("timestamp"))
    stream, mark = in_files(spark, a, "us", 3)
    got = {(r["ip"], r["blocked_at"], r["ended_at"]) for r in drain(stream_blocks(stream.drop("us"), BLOCK_SECONDS, "1 hour")).collect()}
    want = {(r["ip"], r["blocked_at"], r["ended_at"]) for r in blocks(spark, folder).collect() if due_ms(r["ended_at"]) <= mark}
    assert got == want and got


CONTEXT = ["record_id", "unique_dst_ips", "unique_dst_ports", "recent_flows", "recent_bytes", "recent_packets"]


def streamed(spark, parts):
    path = run_dir(spark, "parts")
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", 1).parquet(path)


def batch_context(df, width):
    both = distinct_so_far(df).join(trailing_totals(df, width), ["src_ip", "record_id"])
    return {tuple(r) for r in both.select(*CONTEXT).collect()}


def test_late_records_count_in_event_order(spark):
    """Each batch brings records from before those of earlier batches, new destinations among them, and equal times."""
    rows = [{"at": 1e6 + (i * 7919) % 3000, "src_ip": f"h{i % 2}", "dst_ip": f"d{i % 11}" if i % 5 else None, "dst_port": i % 4, "orig_bytes": i} for i in range(400)]
    rows += [{"at": 1e6 + 1500, "src_ip": "h0", "dst_ip": f"e{i}"} for i in range(5)]
    df = records(spark, rows)
    parts = [df.filter(f"record_id % 4 = {k}") for k in range(4)] + [records(spark, [{"at": 9e6, "src_ip": "z"}]).withColumn("record_id", F.lit(-1).cast("long"))]
    got = drain(stream_host_context(streamed(spark, parts), 100_000_000, "2 hours")).filter("record_id >= 0")
    assert {tuple(r) for r in got.select(*CONTEXT).collect()} == batch_context(df, 100_000_000)


def test_silent_hosts_are_forgotten_on_request(spark):
    early = records(spark, [{"at": 100.0, "dst_ip": "x"}, {"at": 110.0, "dst_ip": "y"}])
    between = records(spark, [{"at": 20_000.0, "src_ip": "other"}]).withColumn("record_id", F.lit(10).cast("long"))
    after = records(spark, [{"at": 40_000.0, "dst_ip": "x"}]).withColumn("record_id", F.lit(20).cast("long"))
    end = records(spark, [{"at": 90_000.0, "src_ip": "other"}]).withColumn("record_id", F.lit(30).cast("long"))
    for idle, ips in ((1, 1), (None, 2)):
        got = {r["record_id"]: r["unique_dst_ips"] for r in drain(stream_host_context(streamed(spark, [early, between, after, end]), 60_000_000, "1 minute", idle)).collect()}
        assert got[0] == 1 and got[1] == 2 and got[20] == ips


def test_a_backlog_of_one_key_is_linear(spark):
    """100,000 rows of one key in one batch: windows, host context and blocks, in seconds and as in batch."""
    df = spark.range(100_000).select(
        F.col("id").alias("record_id"), F.timestamp_micros(F.col("id") * 20_000 + 10**9).alias("ts"), F.lit("a").alias("src_ip"), F.lit(1).alias("src_port"),
        F.concat(F.lit("d"), F.col("id") % 50).alias("dst_ip"), F.lit(80).alias("dst_port"), F.col("id").alias("orig_bytes"),
        F.lit(0).cast("long").alias("resp_bytes"), F.lit(1).cast("long").alias("orig_pkts"), F.lit(0).cast("long").alias("resp_pkts"))
    end = df.limit(1).withColumns({"record_id": F.lit(-1).cast("long"), "ts": F.timestamp_micros(F.lit(10**12))})
    start = time.time()
    one_flow = [d.withColumn("dst_ip", F.lit("b")) for d in (df, end)]
    windows = drain(stream_flow_windows(streamed(spark, one_flow), 60_000_000, 1000, "1 minute")).filter("record_id >= 0")
    assert windows.count() == 100_000 and windows.filter("window_id <> floor(record_id / 1000) * 1000").isEmpty()
    context = drain(stream_host_context(streamed(spark, [df, end]), 60_000_000, "1 minute")).filter("record_id >= 0")
    wrong = context.filter("recent_flows <> least(record_id + 1, 3000) or unique_dst_ips <> least(record_id + 1, 50)")
    assert context.count() == 100_000 and wrong.isEmpty()
    acts_of = lambda d: d.select("src_ip", F.col("ts").alias("timestamp"), F.col("record_id").alias("result_id"), F.lit(0).alias("rank"), F.lit(0).alias("step"), F.lit("block_ip").alias("act"), F.lit("p").alias("policy_name"))
    found = drain(stream_blocks(streamed(spark, [acts_of(df), acts_of(end)]), 300, "1 minute"))
    assert sorted(r["result_id"] for r in found.filter("result_id >= 0").collect()) == list(range(0, 100_000, 15_000))
    assert time.time() - start < 120


def test_live_statistics_write_messages_in_bounded_files(spark, folder, monkeypatch):
    """Three micro-batches of as many files as the rows need."""
    import __spark_entry__ as entry
    from tidewarden.catalog import streams

    taken, original = [], streams.folder_stream
    monkeypatch.setattr(streams, "FILE_ROWS", 100)
    monkeypatch.setattr(streams, "folder_stream", lambda s, path, files: taken.append((files, s.read.format("binaryFile").load(path).count())) or original(s, path, files))
    rows = spark.read.parquet(f"{folder}/events.parquet").count()
    got = entry.queries()["a18_live_statistics"](spark, folder).first()
    files = -(-rows // 300)
    assert taken == [(files, 3 * files)] and files > 1
    assert got["processed"] + got["errors"] == rows


def test_parts_are_micro_batches_of_bounded_files(spark, folder, monkeypatch):
    """Large parts are written by many tasks and stay one micro-batch each, also those of few rows or none."""
    from tidewarden.catalog import streams

    monkeypatch.setattr(streams, "FILE_ROWS", 100)
    f = flows(spark, folder)
    rows, batches = f.count(), []
    parts = [F.col("record_id") < 3, F.lit(False), F.col("record_id") >= 3]
    stream = streams.in_turn(spark, f, parts, "parts")
    stream.writeStream.foreachBatch(lambda batch, number: batches.append(sorted(r[1] for r in batch.groupBy(F.input_file_name()).count().collect()))) \
        .option("checkpointLocation", run_dir(spark, "checkpoint")).trigger(availableNow=True).start().awaitTermination()
    assert [sum(b) for b in batches] == [3, 0, rows - 3]
    assert len(batches[2]) == -(-(rows - 3) // 100) and max(batches[2]) < 200


def test_few_stores_follow_the_cores(spark):
    held = spark.conf.get("spark.sql.shuffle.partitions")
    cores = spark.sparkContext.defaultParallelism
    try:
        for given, stores in ((10_000, STORES_PER_CORE * cores), (2, 2)):
            spark.conf.set("spark.sql.shuffle.partitions", given)
            with few_stores(spark):
                assert int(spark.conf.get("spark.sql.shuffle.partitions")) == stores
            assert int(spark.conf.get("spark.sql.shuffle.partitions")) == given
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", held)
