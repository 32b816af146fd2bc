"""Streams run over everything available, checked against the batch results."""

from pyspark.sql import functions as F

from tidewarden.catalog.decisions import BLOCK_SECONDS, BLOCKS_SQL, acts, results
from tidewarden.catalog.flows import r6
from tidewarden.catalog.logs import eve_lines
from tidewarden.catalog.registry import query
from tidewarden.catalog.tables import (
    CAP, CONTEXT_SQL, DAY, FLOWS_SQL, HOUR, NOW, METRICS_SQL, RESULTS_SQL, SECOND, STATS_SQL, WIDTH, flows, metric_events, windows_sql, with_sql,
)
from tidewarden.catalog.flows import features
from tidewarden.functions.records import micros
from tidewarden.operators import actions as act_ops
from tidewarden.operators.flows import window_statistics
from tidewarden.operators.monitoring import sliding_rates
from tidewarden.operators.policies import decide
from tidewarden.plans.detection import score_flows
from tidewarden.schemas import FLOW_SCHEMA, RESULT_SCHEMA
from tidewarden.session import run_dir
from tidewarden.sinks.keyed import keyed_json, stream_keyed_json
from tidewarden.sources.conn_log import conn_lines
from tidewarden.sources.eve_log import decode_json
from tidewarden.sources.log_tail import CHUNK, opened
from tidewarden.sources.streams import (
    folder_stream, rejects_of, stream_features, stream_flows, stream_metric_events, stream_results, tail_conn_log,
    tail_event_log, with_id,
)
from tidewarden.streaming.runner import drain, drain_per_batch, few_stores, start
from tidewarden.streaming.statistics import StatisticsWriter, live_statistics, observed
from tidewarden.streaming.state import stream_blocks, stream_flow_windows, stream_host_context

LATE = "1 hour"
LATE_US = 3600 * SECOND


def messages(spark, df, key="src_ip"):
    """A folder of JSON messages, standing in for a topic."""
    path = run_dir(spark, "topic")
    keyed_json(df, key).select("value").write.text(path)
    return path


def flow_stream(spark, sf):
    return stream_flows(folder_stream(spark, messages(spark, flows(spark, sf))))


# The last watermark in ms, and the windows it has passed.
WATERMARK_SQL = f"((select max(ts_us) from flows) // 1000 - {LATE_US // 1000})"


@query("s3_stream_flows", with_sql(FLOWS_SQL, "select record_id, ts_us, src_ip, dst_port, orig_bytes, history from flows"))
def _(spark, sf):
    return drain(flow_stream(spark, sf)).select("record_id", micros().alias("ts_us"), "src_ip", "dst_port", "orig_bytes", "history")


@query("s4_stream_features", with_sql(CONTEXT_SQL, "select window_id, src_ip, byte_count, round(entropy, 6) as entropy, recent_flows from features"))
def _(spark, sf):
    s = stream_features(folder_stream(spark, messages(spark, features(spark, sf))))
    return drain(s).select("window_id", "src_ip", "byte_count", r6("entropy"), "recent_flows")


def result_messages(spark, sf):
    return messages(spark, results(spark, sf).select("result_id", *RESULT_SCHEMA.names))


@query("s5_stream_results", with_sql(RESULTS_SQL, "select result_id, prediction, severity, round(risk_score, 6) as risk_score from results"))
def _(spark, sf):
    s = stream_results(folder_stream(spark, result_messages(spark, sf)))
    return drain(s).select("result_id", "prediction", "severity", r6("risk_score"))


@query("s5_stream_decisions", with_sql(RESULTS_SQL, """
select result_id, 'high_risk_attack' as policy_name from results where prediction = 'attack' and severity = 'high' and risk_score >= 0.8
union all select result_id, 'suspicious_activity' from results where prediction = 'suspicious' and severity = 'medium' and risk_score >= 0.6
union all select result_id, 'anomaly_detection' from results where is_anomaly and anomaly_score >= 0.7"""))
def _(spark, sf):
    """Policies need no state: the batch operator runs on the stream as it is."""
    return drain(decide(stream_results(folder_stream(spark, result_messages(spark, sf))))).select("result_id", "policy_name")


@query("s6_stream_metric_events", f"with {METRICS_SQL} select id, type, component, round(latency, 6) as latency from metric_events")
def _(spark, sf):
    s = stream_metric_events(folder_stream(spark, messages(spark, metric_events(spark, sf), F.lit("metrics"))))
    return drain(s).select("id", "type", "component", r6("latency"))


@query("s8_tail_logs", with_sql(FLOWS_SQL, "select uid, ts_us, src_ip, orig_bytes from flows"))
def _(spark, sf):
    """The sensor writes its whole log twice; every record is published once."""
    path = run_dir(spark, "log")
    lines = conn_lines(flows(spark, sf)).select("value")
    lines.write.text(path)
    lines.write.mode("append").text(path)
    return drain(tail_conn_log(spark, path)).select("uid", micros().alias("ts_us"), "src_ip", "orig_bytes")


def grow_log(spark, whole, live, shares):
    """Yield each time the files in ``live`` have grown to the next share of the bytes of those in ``whole``; tasks copy the bytes."""
    def copy_to(share):
        def copy(batches):
            for batch in batches:
                for name in batch.column(0).to_pylist():
                    source, target = opened(whole), opened(live)
                    size = int(source[0].get_file_info(f"{source[1]}/{name}").size * share)
                    with source[0].open_input_file(f"{source[1]}/{name}") as old, target[0].open_output_stream(f"{target[1]}/{name}") as new:
                        for at in range(0, size, CHUNK):
                            new.write(old.read(min(CHUNK, size - at)))
                yield batch
        return copy

    system, folder = opened(live)
    system.create_dir(folder)
    names = spark.read.format("binaryFile").load(whole).select(F.element_at(F.split("path", "/"), -1).alias("name"))  # reads no bytes
    for share in shares:
        names.mapInArrow(copy_to(share), "name string").count()
        yield share


def drain_growing(spark, lines, stream_of):
    """A log that grows in four steps, most of them in the middle of a line; the query is started again after each."""
    whole, live, out, mark = (run_dir(spark, n) for n in ("whole", "live", "stream", "checkpoint"))
    lines.select("value").repartition(3).write.text(whole)
    for _ in grow_log(spark, whole, live, (0.31, 0.32, 0.77, 1.0)):
        stream = stream_of(live)
        start(stream, out, mark, {"availableNow": True}).awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


@query("s8_growing_conn_log", with_sql(FLOWS_SQL, "select uid, ts_us, src_ip, orig_bytes from flows"))
def _(spark, sf):
    """Bytes added to files already read: no line is lost, split or repeated, also over restarts."""
    got = drain_growing(spark, conn_lines(flows(spark, sf)), lambda live: tail_conn_log(spark, live, late=None, piece=50_000))
    return got.select("uid", micros().alias("ts_us"), "src_ip", "orig_bytes")


@query("s8_growing_event_log", with_sql(FLOWS_SQL, """
select record_id, case when src_port > 1024 then src_ip else 'unknown' end as key, service as event_type from flows where record_id % 25 <> 3"""))
def _(spark, sf):
    got = drain_growing(spark, eve_lines(spark, sf), lambda live: tail_event_log(spark, live, piece=70_000))
    return got.select(F.col("flow_id").alias("record_id"), F.coalesce("src_ip", F.lit("unknown")).alias("key"), "event_type")


@query("t4_resent_rows", with_sql(FLOWS_SQL, "select record_id, src_ip from flows"))
def _(spark, sf):
    f = flows(spark, sf)
    path = messages(spark, f.unionByName(f.filter("record_id % 3 = 0")))
    s = stream_flows(folder_stream(spark, path)).withWatermark("ts", LATE).dropDuplicatesWithinWatermark(["record_id"])
    return drain(s).select("record_id", "src_ip")


CLOSED_SQL = f"(window_at + {WIDTH}) // 1000 + 1 <= {WATERMARK_SQL}"


@query("t1_stream_windows", with_sql(windows_sql(), f"select record_id, flow_key, window_at, window_id from windowed where {CLOSED_SQL}"))
def _(spark, sf):
    """All windows that the last watermark has passed."""
    w = stream_flow_windows(flow_stream(spark, sf), WIDTH, CAP, LATE)
    return drain(w).select("record_id", "flow_key", "window_at", "window_id")


@query("t1_stream_features", with_sql(STATS_SQL, f"select flow_key, window_id, byte_count, packet_count, round(entropy, 6) as entropy from stats where {CLOSED_SQL}"))
def _(spark, sf):
    """A window's records leave the state together, so the batch statistics apply to every micro-batch."""
    w = stream_flow_windows(flow_stream(spark, sf), WIDTH, CAP, LATE)
    return drain_per_batch(w, window_statistics).select("flow_key", "window_id", "byte_count", "packet_count", r6("entropy"))


FILE_ROWS = 500_000


def files_per_batch(rows, batches):
    """How many files of at most about ``FILE_ROWS`` rows each of so many micro-batches takes."""
    return max(-(-rows // (batches * FILE_ROWS)), 1)


def in_turn(spark, df, parts, kind):
    """A stream in which the rows of each of ``parts`` are one micro-batch, and the files of its folder in that order.

    All parts have the same number of files, each of at most about ``FILE_ROWS`` rows, so large parts are written and read in many tasks.
    """
    path = run_dir(spark, kind)
    rows = df.agg(*[F.count_if(part) for part in parts]).first()
    files = files_per_batch(max(rows), 1)
    written = spark.read.schema(df.schema)
    for k, part in enumerate(parts, start=1):
        df.filter(part).repartition(files, "record_id").write.mode("append").parquet(path)
        for _ in range(k * files - len(written.parquet(path).inputFiles())):  # a task without rows leaves no file
            df.limit(0).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(path)


def out_of_order(spark, sf, hours=48, parts=5):
    """Parts in order of arrival, one a micro-batch: each record is up to ``hours`` late, so none falls behind a watermark of that delay."""
    f = flows(spark, sf)
    arrival = F.unix_micros("ts") + F.col("record_id") * 37 % hours * HOUR
    first, last = f.agg(F.min(arrival), F.max(arrival)).first()
    bounds = [first + (last + 1 - first) * k // parts for k in range(parts + 1)]
    return in_turn(spark, f, [(arrival >= low) & (arrival < high) for low, high in zip(bounds, bounds[1:])], "late")


@query("t2_stream_host_context", with_sql(FLOWS_SQL, f"""
select f.record_id, f.src_ip, count(distinct g.dst_ip) as unique_dst_ips, count(distinct case when g.dst_port <> 0 then g.dst_port end) as unique_dst_ports,
  count(case when g.ts_us > f.ts_us - {WIDTH} then 1 end) as recent_flows,
  cast(sum(case when g.ts_us > f.ts_us - {WIDTH} then g.orig_bytes + g.resp_bytes else 0 end) as bigint) as recent_bytes
from flows f join flows g on g.src_ip = f.src_ip and g.ts_us <= f.ts_us
where f.ts_us // 1000 + 1 <= (select max(ts_us) from flows) // 1000 - {48 * HOUR // 1000} group by 1, 2"""))
def _(spark, sf):
    """Five micro-batches of records that arrive out of order; all that the last watermark has passed, as in batch."""
    with few_stores(spark):
        context = drain(stream_host_context(out_of_order(spark, sf), WIDTH, "48 hours"))
    return context.select("record_id", "src_ip", "unique_dst_ips", "unique_dst_ports", "recent_flows", "recent_bytes")


@query("t3_stream_blocks", with_sql(BLOCKS_SQL, f"""
select ip, policy_name, blocked_at, ended_at, result_id from blocks
where ended_at // 1000 + 1 <= ((select max(ts_us) from acts) // 1000 - {LATE_US // 1000})"""))
def _(spark, sf):
    """All blocks that have ended by the last watermark."""
    path = run_dir(spark, "acts")
    a = acts(spark, sf).filter("act in ('block_ip', 'allow')")
    a.write.parquet(path)
    stream = spark.readStream.schema(a.schema).parquet(path)
    return drain(stream_blocks(stream, BLOCK_SECONDS, LATE)).select("ip", "policy_name", "blocked_at", "ended_at", "result_id")


def staged(spark, sf):
    """Three parts in order: the first half of the month, half of the rest, then the remainder with stragglers
    of the first half. A watermark drops late rows from the second batch after the one that set it."""
    first_half = F.col("ts") < F.timestamp_seconds(F.lit(1705320000))
    straggler = first_half & (F.col("record_id") % 50 == 0)
    odd = F.col("record_id") % 2 == 1
    return in_turn(spark, flows(spark, sf), [first_half & ~straggler, ~first_half & ~odd, (~first_half & odd) | straggler], "staged")


@query("t5_late_rows", with_sql(FLOWS_SQL, f""",
early as (select max(ts_us) // 1000 - {LATE_US // 1000} as mark from flows where ts_us < 1705320000000000 and record_id % 50 <> 0),
kept as (select ts_us // {DAY} * {DAY} as day from flows, early where not (ts_us < 1705320000000000 and record_id % 50 = 0 and (ts_us // {DAY} * {DAY} + {DAY}) // 1000 <= mark))
select day as start_us, count(*) as records from kept where (day + {DAY}) // 1000 <= {WATERMARK_SQL} group by 1"""))
def _(spark, sf):
    """Records per day; a straggler counts only while its day is still open."""
    s = staged(spark, sf).withWatermark("ts", LATE).groupBy(F.window("ts", "1 day").alias("span")).agg(F.count(F.lit(1)).alias("records"))
    return drain(s).select(micros("span.start").alias("start_us"), "records")


METRIC_MARK_SQL = f"((select max(ts_us) from metric_events) // 1000 - {LATE_US // 1000})"
RATES_SQL = f"""with {METRICS_SQL},
spans as (select unnest([ts_us // {DAY // 2} * {DAY // 2}, (ts_us // {DAY // 2} - 1) * {DAY // 2}]) as start_us, coalesce(type, 'unknown') as type from metric_events),
closed as (select start_us, type, count(*) as events from spans where (start_us + {DAY}) // 1000 <= {METRIC_MARK_SQL} group by 1, 2)
"""


def rate_stream(spark, sf):
    lines = folder_stream(spark, messages(spark, metric_events(spark, sf), F.lit("metrics")))
    return sliding_rates(stream_metric_events(lines).withWatermark("timestamp", LATE), "24 hours", "12 hours")


@query("t6_sliding_rates", RATES_SQL + "select * from closed")
def _(spark, sf):
    return drain(rate_stream(spark, sf)).select(micros("span.start").alias("start_us"), "type", "events")


@query("k5_aggregated_metrics", RATES_SQL + "select 'metrics' as key, type, cast(sum(events) as bigint) as events from closed group by 2")
def _(spark, sf):
    """Closed rate windows through the keyed sink (every 30 s in operation), decoded and added up per type."""
    rates = rate_stream(spark, sf).select(micros("span.start").alias("start_us"), "type", "events")
    out = run_dir(spark, "topic")
    stream_keyed_json(rates, F.lit("metrics"), run_dir(spark, "checkpoint"), out, {"availableNow": True}).awaitTermination()
    sent = spark.read.schema("key string, value string").parquet(out)
    got = sent.select("key", F.from_json("value", rates.schema).alias("r")).select("key", "r.*")
    return got.groupBy("key", "type").agg(F.sum("events").alias("events"))


@query("t7_micro_batches", with_sql(FLOWS_SQL, "select protocol, count(*) as records from flows group by 1"))
def _(spark, sf):
    """Three triggers over a staged folder; each file is read once."""
    return drain(staged(spark, sf).select("record_id", "protocol")).groupBy("protocol").agg(F.count(F.lit(1)).alias("records"))


@query("t8_restart_from_checkpoint", with_sql(FLOWS_SQL, "select record_id, src_ip from flows"))
def _(spark, sf):
    """A query stopped after the first part and started again reads only the second part."""
    source, out, mark = run_dir(spark, "parts"), run_dir(spark, "stream"), run_dir(spark, "checkpoint")
    f = flows(spark, sf).select("record_id", "src_ip")
    for part in (f.filter("record_id % 2 = 0"), f.filter("record_id % 2 = 1")):
        part.write.mode("append").parquet(source)
        stream = spark.readStream.schema(f.schema).parquet(source)
        start(stream, out, mark, {"availableNow": True}).awaitTermination()
    return spark.read.parquet(out)


@query("t9_stream_rejects", with_sql(FLOWS_SQL, "select 'not JSON' as reject_reason, count(*) as messages from flows where record_id % 40 = 1"))
def _(spark, sf):
    f = flows(spark, sf)
    path = run_dir(spark, "topic")
    f.select(F.when(F.col("record_id") % 40 == 1, "{broken").otherwise(F.to_json(F.struct("*"))).alias("value")).write.text(path)
    return drain(rejects_of(folder_stream(spark, path), FLOW_SCHEMA)).groupBy("reject_reason").agg(F.count(F.lit(1)).alias("messages"))


@query("e1_record_callback", with_sql(FLOWS_SQL, "select record_id, protocol || '/' || service as tag from flows"))
def _(spark, sf):
    """A user's function on every micro-batch of records."""
    tag = lambda batch: batch.select("record_id", F.concat_ws("/", "protocol", "service").alias("tag"))
    return drain_per_batch(flow_stream(spark, sf), tag)


@query("a18_live_statistics", with_sql(FLOWS_SQL, f"""
select 'capture' as stage, count(case when record_id % 40 <> 1 then 1 end) as processed, count(case when record_id % 40 = 1 then 1 end) as errors,
  round(({NOW} - min(case when record_id % 40 <> 1 then ts_us end)) / 1e6, 2) as uptime_seconds,
  round(count(case when record_id % 40 <> 1 then 1 end) / (({NOW} - min(case when record_id % 40 <> 1 then ts_us end)) / 1e6), 6) as per_second from flows"""))
def _(spark, sf):
    """Counts taken while a stream of messages runs in three micro-batches, some messages broken; nothing is read again for them."""
    path, folder = run_dir(spark, "topic"), run_dir(spark, "statistics")
    f = flows(spark, sf)
    files = files_per_batch(f.count(), 3)
    f.select(F.when(F.col("record_id") % 40 == 1, "{broken").otherwise(F.to_json(F.struct("*"))).alias("value")).repartition(3 * files).write.text(path)
    decoded = decode_json(folder_stream(spark, path, files), with_id(FLOW_SCHEMA, "record_id"))
    counted = observed(decoded, "capture", micros(), F.col("reject_reason").isNotNull()).filter("reject_reason is null")
    writer = StatisticsWriter(spark, folder)
    spark.streams.addListener(writer)
    try:
        writer.wait_for(start(counted.drop("value"), run_dir(spark, "stream"), run_dir(spark, "checkpoint"), {"availableNow": True}))
    finally:
        spark.streams.removeListener(writer)
    return live_statistics(spark, folder, NOW).select(
        "stage", "processed", "errors", F.round("uptime_seconds", 2).alias("uptime_seconds"), r6("per_second"))
