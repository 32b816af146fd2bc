"""Counters, histogram, gauges, rates, host alerts and stage statistics."""

from pyspark.sql import functions as F

from tidewarden.catalog.decisions import DECISIONS_SQL, results_of
from tidewarden.catalog.flows import r6, stats
from tidewarden.catalog.registry import query
from tidewarden.catalog.tables import (
    DAY, FLOWS_SQL, METRICS_SQL, NOW, READINGS_SQL, SECOND, blacklist, flows, host_readings, metric_events, table, whitelist, with_sql,
)
from tidewarden.functions.records import micros, or_default
from tidewarden.operators import hosts, monitoring as m
from tidewarden.operators.policies import DEFAULT_POLICIES, decide
from tidewarden.session import materialize
from tidewarden.sources.conn_log import conn_lines, good_rows, parse_conn_lines, rejected_rows

# `events` is sparse: these windows hold about as many events as the usual 60 s and 300 s do in live traffic.
RATE_SECONDS = 6 * 3600
SUMMARY_SECONDS = 5 * 86400


@query("p14_metric_routing", f"""with {METRICS_SQL}
select id, case type when 'packet_processed' then 'ids_packets_processed_total' when 'feature_extracted' then 'ids_features_extracted_total'
    when 'inference_completed' then 'ids_inferences_completed_total' when 'anomaly_detected' then 'ids_anomalies_detected_total'
    when 'attack_classified' then 'ids_attacks_classified_total' when 'block_executed' then 'ids_blocks_executed_total'
    when 'alert_generated' then 'ids_alerts_generated_total' else 'ids_errors_total' end as metric,
  case type when 'packet_processed' then coalesce(source, 'unknown') when 'feature_extracted' then feature_type
    when 'inference_completed' then coalesce(model_name, 'unknown') when 'anomaly_detected' then coalesce(severity, 'low')
    when 'attack_classified' then attack_type when 'block_executed' then policy_name when 'alert_generated' then coalesce(severity, 'low')
    else component end as first_label
from metric_events where type not in ('processing_latency', 'custom_metric')""")
def _(spark, sf):
    return m.route(metric_events(spark, sf)).select("id", "metric", F.get("label_values", F.lit(0)).alias("first_label"))


@query("a13_events_by_type", f"with {METRICS_SQL} select coalesce(type, 'unknown') as type, count(*) as events from metric_events group by 1")
def _(spark, sf):
    return m.events_by_type(metric_events(spark, sf))


LAST_SQL = METRICS_SQL + f""",
newest as (select * from metric_events order by ts_us desc, id desc limit 100)"""


@query("l2_latest_events", f"with {LAST_SQL} select id, ts_us, type from newest")
def _(spark, sf):
    e = metric_events(spark, sf).select("id", micros("timestamp").alias("ts_us"), "type")
    return m.latest(e, ["ts_us", "id"], 100)


@query("a14_minute_rates", f"""with {LAST_SQL}
select coalesce(type, 'unknown') as type, count(*) as events,
  count(case when type is not null and ts_us > {NOW} - {RATE_SECONDS * SECOND} then 1 end) as per_minute from newest group by 1""")
def _(spark, sf):
    return m.minute_rates(metric_events(spark, sf), NOW, ["timestamp", "id"], window=RATE_SECONDS)


@query("w6_sliding_rates", f"""with {METRICS_SQL},
spans as (select ts_us, type, unnest([ts_us // {DAY // 2} * {DAY // 2}, (ts_us // {DAY // 2} - 1) * {DAY // 2}]) as start_us from metric_events)
select start_us, coalesce(type, 'unknown') as type, count(*) as events from spans group by 1, 2""")
def _(spark, sf):
    s = m.sliding_rates(metric_events(spark, sf), "24 hours", "12 hours")
    return s.select(micros("span.start").alias("start_us"), "type", "events")


COUNTER_SELECT = """,
labelled as (
  select 'ids_packets_processed_total' as metric, coalesce(source, 'unknown') as label1, protocol as label2 from metric_events where type = 'packet_processed'
  union all select 'ids_features_extracted_total', feature_type, null from metric_events where type = 'feature_extracted'
  union all select 'ids_inferences_completed_total', coalesce(model_name, 'unknown'), prediction from metric_events where type = 'inference_completed'
  union all select 'ids_anomalies_detected_total', coalesce(severity, 'low'), null from metric_events where type = 'anomaly_detected'
  union all select 'ids_attacks_classified_total', attack_type, coalesce(severity, 'low') from metric_events where type = 'attack_classified'
  union all select 'ids_blocks_executed_total', policy_name, coalesce(reason, 'unknown') from metric_events where type = 'block_executed'
  union all select 'ids_alerts_generated_total', coalesce(severity, 'low'), policy_name from metric_events where type = 'alert_generated'
  union all select 'ids_errors_total', component, error_type from metric_events where type = 'error_occurred')
select metric, label1, label2, count(*) as value from labelled group by 1, 2, 3"""


@query("a15_counters", f"with {METRICS_SQL}{COUNTER_SELECT}")
def _(spark, sf):
    labels = F.map_values("labels")
    return m.counters(metric_events(spark, sf)).select("metric", F.get(labels, F.lit(0)).alias("label1"), F.get(labels, F.lit(1)).alias("label2"), "value")


HISTOGRAM_SQL = f"""with {METRICS_SQL},
timed as (select component, coalesce(operation, 'unknown') as operation, coalesce(latency, 0.0) as latency from metric_events where type = 'processing_latency'),
bounds(le, bound) as (values ('0.001', 0.001::double), ('0.005', 0.005::double), ('0.01', 0.01::double), ('0.05', 0.05::double), ('0.1', 0.1::double),
  ('0.5', 0.5::double), ('1.0', 1.0::double), ('5.0', 5.0::double), ('+Inf', 'infinity'::double))
select component, operation, le, count(case when latency <= bound then 1 end) as cumulative, count(*) as observations, round(sum(latency), 6) as latency_sum
from timed cross join bounds group by 1, 2, 3"""


@query("a16_latency_histogram", HISTOGRAM_SQL)
def _(spark, sf):
    return m.latency_histogram(metric_events(spark, sf)).select("component", "operation", "le", "cumulative", "observations", r6("latency_sum"))


@query("j9_latency_buckets", f"""with {METRICS_SQL},
bounds(bound) as (values (0.001), (0.005), (0.01), (0.05), (0.1), (0.5), (1.0), (5.0))
select cast(bound as varchar) as le, count(*) as observations from metric_events join bounds on coalesce(latency, 0.0) <= cast(bound as double)
where type = 'processing_latency' group by 1""")
def _(spark, sf):
    h = m.latency_histogram(metric_events(spark, sf)).filter("le <> '+Inf'")
    three = F.format_string("%.3f", F.col("le").cast("double"))
    return h.groupBy(three.alias("le")).agg(F.sum("cumulative").alias("observations")).filter("observations > 0")


@query("a17_gauges", f"""with {READINGS_SQL},
points as (
  select 'ids_system_cpu_percent' as name, '' as label, cpu_percent as value, ts_us, id from readings
  union all select 'ids_system_memory_percent', '', memory_percent, ts_us, id from readings
  union all select 'ids_system_load_average', '1m', load1, ts_us, id from readings
  union all select 'ids_system_load_average', '5m', load5, ts_us, id from readings
  union all select 'ids_system_load_average', '15m', load15, ts_us, id from readings)
select name, label, round(arg_max(value, (ts_us, id)), 6) as value from points group by 1, 2""")
def _(spark, sf):
    point = lambda name, label, value: F.struct(F.lit(name).alias("name"), F.lit(label).alias("label"), value.alias("value"))
    load = lambda i: F.get("load_average", F.lit(i))
    p = host_readings(spark, sf).select(micros("timestamp").alias("at"), "id", F.inline(F.array(
        point("ids_system_cpu_percent", "", F.col("cpu_percent")), point("ids_system_memory_percent", "", F.col("memory_percent")),
        point("ids_system_load_average", "1m", load(0)), point("ids_system_load_average", "5m", load(1)),
        point("ids_system_load_average", "15m", load(2)))))
    return m.gauges(p).select("name", "label", r6("value"))


ALERTS_SQL = READINGS_SQL + """,
host_alerts as (
  select id, ts_us, 'high_cpu' as type, case when cpu_percent < 90 then 'warning' else 'critical' end as severity, cpu_percent as value, 80.0 as threshold from readings where cpu_percent > 80
  union all select id, ts_us, 'high_memory', case when memory_percent < 95 then 'warning' else 'critical' end, memory_percent, 85.0 from readings where memory_percent > 85
  union all select id, ts_us, 'high_disk', case when disk_usage_percent < 95 then 'warning' else 'critical' end, disk_usage_percent, 90.0 from readings where disk_usage_percent > 90
  union all select id, ts_us, 'high_load', case when load1 < 8 then 'warning' else 'critical' end, load1, 4.0 from readings where load1 > 4)"""


@query("p15_host_alerts", f"with {ALERTS_SQL} select id, ts_us, type, severity, round(value, 6) as value, cast(threshold as double) as threshold from host_alerts")
def _(spark, sf):
    return m.host_alerts(host_readings(spark, sf)).select("id", micros("timestamp").alias("ts_us"), "type", "severity", r6("value"), "threshold")


@query("p16_alert_messages", f"""with {ALERTS_SQL}
select id, type, 'System alert: ' || type || ' is ' || cast(floor(value) as bigint) || ' (threshold: ' || cast(floor(threshold) as bigint) || ')' as message from host_alerts""")
def _(spark, sf):
    """The message with whole numbers, which both engines print alike."""
    a = m.host_alerts(host_readings(spark, sf))
    return a.select("id", "type", m.alert_message(F.col("type"), F.floor("value"), F.floor("threshold")).alias("message"))


@query("l4_latest_host", f"""with {READINGS_SQL}
select round(cpu_percent, 6) as cpu_percent, round(memory_percent, 6) as memory_percent, round(disk_usage_percent, 6) as disk_usage_percent, round(load1, 6) as load1
from readings order by ts_us desc, id desc limit 1""")
def _(spark, sf):
    r = m.latest_host(host_readings(spark, sf))
    return r.select(r6("cpu_percent"), r6("memory_percent"), r6("disk_usage_percent"), F.round(F.get("load_average", F.lit(0)), 6).alias("load1"))


@query("l5_host_history", f"""with {READINGS_SQL}
select host, id, round(cpu_percent, 6) as cpu_percent from readings qualify row_number() over (partition by host order by ts_us desc, id desc) <= 50""")
def _(spark, sf):
    r = host_readings(spark, sf).select("host", "id", "timestamp", "cpu_percent")
    return hosts.last_per_key(r, ["host"], ["timestamp", "id"], 50).select("host", "id", r6("cpu_percent"))


@query("a22_metrics_summary", f"""with {METRICS_SQL}
select coalesce(type, 'unknown') as type, count(*) as events, cast(sum(count(*)) over () as bigint) as total_events
from metric_events where ts_us > {NOW} - {SUMMARY_SECONDS * SECOND} group by 1""")
def _(spark, sf):
    summary = m.metrics_summary(metric_events(spark, sf), host_readings(spark, sf), NOW, SUMMARY_SECONDS)
    return summary.select("type", "events", "total_events")


@query("a22_summary_with_host", f"""with {METRICS_SQL}, {READINGS_SQL.strip()},
newest as (select * from readings order by ts_us desc, id desc limit 1)
select coalesce(type, 'unknown') as type, count(*) as events, round(any_value(cpu_percent), 6) as cpu_percent,
  round(any_value(memory_percent), 6) as memory_percent, round(any_value(disk_usage_percent), 6) as disk_usage_percent, round(any_value(load15), 6) as load15
from metric_events, (select cpu_percent, memory_percent, disk_usage_percent, load15 from newest) as host
where ts_us > {NOW} - {SUMMARY_SECONDS * SECOND} group by 1""")
def _(spark, sf):
    """The summary with its host part: the newest reading of all."""
    summary = m.metrics_summary(metric_events(spark, sf), host_readings(spark, sf), NOW, SUMMARY_SECONDS)
    return summary.select("type", "events", r6("cpu_percent"), r6("memory_percent"), r6("disk_usage_percent"),
                          F.round(F.get("load_average", F.lit(2)), 6).alias("load15"))


@query("e4_custom_metric", f"""with base as (select event_type, avg(value) as v, max(epoch_us(ts)) as ts_us from events group by 1)
select 'custom_metric' as type, 'mean_value' as name, round(v, 6) as value, event_type as source, ts_us from base""")
def _(spark, sf):
    p = table(spark, sf, "events").groupBy("event_type").agg(F.avg("value").alias("value"), F.max(F.col("ts").cast("timestamp")).alias("timestamp"))
    p = p.withColumns({"name": F.lit("mean_value"), "labels": F.create_map(F.lit("source"), F.col("event_type"))})
    return m.custom_metric(p).select("type", "name", r6("value"), F.col("labels")["source"].alias("source"), micros("timestamp").alias("ts_us"))


@query("u2_append_events", f"""with {METRICS_SQL}
select type, count(*) as events, count(latency) as with_latency from metric_events where type is not null group by 1
union all select 'custom_metric_added', count(*), 0 from (select event_type from events group by 1)""")
def _(spark, sf):
    p = table(spark, sf, "events").groupBy("event_type").agg(F.avg("value").alias("value"), F.max(F.col("ts").cast("timestamp")).alias("timestamp"))
    p = p.withColumns({"name": F.lit("mean_value"), "labels": F.create_map().cast("map<string,string>")})
    added = m.custom_metric(p).withColumn("type", F.lit("custom_metric_added"))
    both = metric_events(spark, sf).filter("type is not null").unionByName(added, allowMissingColumns=True)
    return both.groupBy("type").agg(F.count(F.lit(1)).alias("events"), F.count("latency").alias("with_latency"))


@query("a18_stage_statistics", with_sql(FLOWS_SQL, f"""
select 'capture' as stage, count(case when record_id % 50 <> 7 then 1 end) as processed, count(case when record_id % 50 = 7 then 1 end) as errors,
  round(({NOW} - min(case when record_id % 50 <> 7 then ts_us end)) / 1e6, 3) as uptime_seconds,
  round(count(case when record_id % 50 <> 7 then 1 end) / (({NOW} - min(case when record_id % 50 <> 7 then ts_us end)) / 1e6), 6) as per_second from flows"""))
def _(spark, sf):
    """The capture stage over all records, some of whose log lines hold a bad number."""
    lines = conn_lines(flows(spark, sf)).withColumn(
        "value", F.when(F.col("record_id") % 50 == 7, F.regexp_replace("value", r"\t\d+\t10|\t10", "\tx\t")).otherwise(F.col("value")))
    parsed = parse_conn_lines(materialize(lines))
    s = m.stage_statistics(good_rows(parsed).withColumn("at", micros()), rejected_rows(parsed), NOW, "at")
    return s.select(F.lit("capture").alias("stage"), "processed", "errors", F.round("uptime_seconds", 3).alias("uptime_seconds"), r6("per_second"))


@query("a18_all_stages", with_sql(DECISIONS_SQL + ",\n" + METRICS_SQL.replace("base as", "metric_base as").replace("from base)", "from metric_base)"), f"""
, written as (
  select 'features' as stage, first_at as moment, true as good from stats
  union all select 'scoring', ts_us, true from results
  union all select 'decisions', ts_us, true from decisions
  union all select 'metrics', ts_us, type is not null from metric_events),
stage_totals as (
  select stage, count(case when good then 1 end) as processed, count(case when not good then 1 end) as errors,
    ({NOW} - min(case when good then moment end)) / 1e6 as uptime from written group by 1)
select stage, processed, errors, round(uptime, 3) as uptime_seconds, round(processed / uptime, 6) as per_second from stage_totals"""))
def _(spark, sf):
    """The stages after capture; a metric event without a type is an error of its stage. Windows and results are computed once."""
    windows = materialize(stats(spark, sf, text=True))
    scored = materialize(results_of(windows))
    decided = decide(scored, DEFAULT_POLICIES, whitelist(spark, sf), blacklist(spark, sf))
    events = metric_events(spark, sf).withColumn("at", micros("timestamp"))
    found = m.stages_statistics({
        "features": (windows, None, "first_at"),
        "scoring": (scored.withColumn("at", micros("timestamp")), None, "at"),
        "decisions": (decided.withColumn("at", micros("timestamp")), None, "at"),
        "metrics": (events.filter("type is not null"), events.filter("type is null"), "at"),
    }, NOW)
    return found.select("stage", "processed", "errors", F.round("uptime_seconds", 3).alias("uptime_seconds"), r6("per_second"))
