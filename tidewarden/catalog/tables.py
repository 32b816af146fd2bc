"""Adapters: network records derived from the given tables, in Spark and as SQL text for the value check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SECOND = 1_000_000
HOUR = 3600 * SECOND
DAY = 24 * HOUR

# `events` is sparse (a few hundred records a day), so the registered queries use a 24 h window.
WIDTH = DAY
CAP = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def k_of_props() -> Column:
    return F.get_json_object("props", "$.k").cast("long")


def flow_columns(df: DataFrame) -> DataFrame:
    """Event rows to flow records; works on a batch and on a stream."""
    k, user, value = F.col("k"), F.col("user_id"), F.col("value")
    df = df.withColumn("k", k_of_props()).withColumn("ts", F.col("ts").cast("timestamp"))
    pick = lambda by, *names: F.element_at(F.array(*[F.lit(n) for n in names]), (by % len(names) + 1).cast("int"))
    return df.select(
        F.col("event_id").alias("record_id"),
        "ts",
        F.concat(F.lit("C"), F.col("event_id").cast("string")).alias("uid"),
        F.concat(F.lit("10.0.0."), (user % 15).cast("string")).alias("src_ip"),
        (user % 3 + 1024).cast("int").alias("src_port"),
        F.concat(F.lit("192.168.0."), (k % 4).cast("string")).alias("dst_ip"),
        pick(k, 0, 22, 53, 80, 443).alias("dst_port"),
        F.when(F.col("event_type") == "error", "icmp").when(F.col("event_type") == "signup", "udp")
        .otherwise("tcp").alias("protocol"),
        F.col("event_type").alias("service"),
        (value / 10).alias("duration"),
        F.floor(value * 100).alias("orig_bytes"),
        F.floor(value * 37).alias("resp_bytes"),
        pick(k, "SF", "S0", "REJ").alias("conn_state"),
        (k % 2 == 0).alias("local_orig"),
        (k % 3 == 0).alias("local_resp"),
        (k % 3).alias("missed_bytes"),
        pick(k, "ShADadFf", "S0R", "SAPF", "-").alias("history"),
        (k % 7 + 1).alias("orig_pkts"),
        (F.floor(value * 100) + 40 * (k % 7 + 1)).alias("orig_ip_bytes"),
        (k % 5).alias("resp_pkts"),
        (F.floor(value * 37) + 40 * (k % 5)).alias("resp_ip_bytes"),
    )


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow_columns(table(spark, sf_dir, "events"))


FLOWS_SQL = """
base as (select *, cast(json_extract_string(props, '$.k') as bigint) as k from events),
flows as materialized (
  select event_id as record_id, epoch_us(ts) as ts_us, 'C' || event_id as uid,
    '10.0.0.' || (user_id % 15) as src_ip, cast(1024 + user_id % 3 as integer) as src_port,
    '192.168.0.' || (k % 4) as dst_ip,
    cast(case k % 5 when 0 then 0 when 1 then 22 when 2 then 53 when 3 then 80 else 443 end as integer) as dst_port,
    case event_type when 'error' then 'icmp' when 'signup' then 'udp' else 'tcp' end as protocol,
    event_type as service, value / 10 as duration,
    cast(floor(value * 100) as bigint) as orig_bytes, cast(floor(value * 37) as bigint) as resp_bytes,
    case k % 3 when 0 then 'SF' when 1 then 'S0' else 'REJ' end as conn_state,
    k % 2 = 0 as local_orig, k % 3 = 0 as local_resp, k % 3 as missed_bytes,
    case k % 4 when 0 then 'ShADadFf' when 1 then 'S0R' when 2 then 'SAPF' else '-' end as history,
    1 + k % 7 as orig_pkts, cast(floor(value * 100) as bigint) + 40 * (1 + k % 7) as orig_ip_bytes,
    k % 5 as resp_pkts, cast(floor(value * 37) as bigint) + 40 * (k % 5) as resp_ip_bytes
  from base)"""


def windows_sql(width: int = WIDTH, cap: int = CAP) -> str:
    """``windowed``: flows with flow_key, window_at, window_id, by a recursive walk over the jumps."""
    return FLOWS_SQL + f""",
keyed as materialized (
  select *, src_ip || ':' || src_port || '-' || dst_ip || ':' || dst_port as flow_key from flows),
ranked as materialized (
  select *, row_number() over (partition by flow_key order by ts_us, record_id) as rn,
    count(*) over (partition by flow_key order by ts_us range between unbounded preceding and {width} following) as aged
  from keyed),
jumps as materialized (select flow_key, rn, least(rn + {cap}, aged + 1) as nrn from ranked),
opened as (
  select flow_key, rn, nrn from jumps where rn = 1
  union all
  select j.flow_key, j.rn, j.nrn from opened o join jumps j on j.flow_key = o.flow_key and j.rn = o.nrn),
placed as materialized (
  select r.*, max(o.rn) over (partition by r.flow_key order by r.rn) as wrn
  from ranked r left join opened o on o.flow_key = r.flow_key and o.rn = r.rn),
windowed as materialized (
  select p.*, f.ts_us as window_at, f.record_id as window_id
  from placed p join ranked f on f.flow_key = p.flow_key and f.rn = p.wrn)"""


def with_sql(ctes: str, select: str) -> str:
    return f"with recursive {ctes}\n{select}"


# One row per flow window with its statistics, and the host context of each.
STATS_SQL = windows_sql() + """,
sizes as (
  select window_id, orig_bytes / orig_pkts as s from windowed where orig_pkts > 0
  union all select window_id, resp_bytes / resp_pkts from windowed where resp_pkts > 0),
size_stats as (
  select window_id, avg(s) as avg_packet_size, stddev_pop(s) as std_packet_size, min(s) as min_packet_size,
    max(s) as max_packet_size from sizes group by 1),
letters as (
  select window_id, unnest(string_split(uid || src_ip || dst_ip || protocol || service || conn_state || history, '')) as c
  from windowed),
letter_counts as (select window_id, c, count(*) as n from letters group by 1, 2),
entropies as (
  select window_id, log2(sum(n)) - sum(n * log2(n)) / sum(n) as entropy from letter_counts group by 1),
totals as (
  select flow_key, window_at, window_id, count(*) as record_count, max(src_ip) as src_ip, max(dst_ip) as dst_ip,
    max(src_port) as src_port, max(dst_port) as dst_port,
    max(case when record_id = window_id then protocol end) as protocol, min(ts_us) as first_at, max(ts_us) as last_at,
    cast(sum(orig_bytes + resp_bytes) as bigint) as byte_count, cast(sum(orig_pkts + resp_pkts) as bigint) as packet_count,
    cast(sum(length(history) - length(replace(history, 'S', ''))) as bigint) as syn,
    cast(sum(length(history) - length(replace(history, 'A', ''))) as bigint) as ack,
    cast(sum(length(history) - length(replace(history, 'F', ''))) as bigint) as fin,
    cast(sum(length(history) - length(replace(history, 'R', ''))) as bigint) as rst,
    cast(sum(length(history) - length(replace(history, 'P', ''))) as bigint) as psh,
    cast(sum(length(history) - length(replace(history, 'U', ''))) as bigint) as urg
  from windowed group by 1, 2, 3),
stats as materialized (
  select t.*, (last_at - first_at) / 1e6 as duration, coalesce(avg_packet_size, 0) as avg_packet_size,
    coalesce(std_packet_size, 0) as std_packet_size, coalesce(min_packet_size, 0) as min_packet_size,
    coalesce(max_packet_size, 0) as max_packet_size, coalesce(entropy, 0) as entropy,
    case when last_at > first_at then packet_count / ((last_at - first_at) / 1e6) else 0 end as packets_per_second,
    case when last_at > first_at then byte_count / ((last_at - first_at) / 1e6) else 0 end as bytes_per_second,
    extract(hour from make_timestamp(first_at)) + extract(minute from make_timestamp(first_at)) / 60.0 as time_of_day,
    cast(extract(isodow from make_timestamp(first_at)) - 1 as integer) as day_of_week
  from totals t left join size_stats using (window_id) left join entropies using (window_id))"""

CONTEXT_SQL = STATS_SQL + f""",
recent as (
  select s.window_id, count(*) as recent_flows, cast(sum(orig_bytes + resp_bytes) as bigint) as recent_bytes,
    cast(sum(orig_pkts + resp_pkts) as bigint) as recent_packets
  from stats s join flows f on f.src_ip = s.src_ip and f.ts_us > s.first_at - {WIDTH} and f.ts_us <= s.last_at group by 1),
seen as (
  select s.window_id, count(distinct f.dst_ip) as unique_dst_ips,
    count(distinct case when f.dst_port <> 0 then f.dst_port end) as unique_dst_ports
  from stats s join flows f on f.src_ip = s.src_ip and f.ts_us <= s.last_at group by 1),
features as materialized (
  select s.*, recent_flows, recent_bytes, recent_packets, unique_dst_ips, unique_dst_ports
  from stats s join recent using (window_id) join seen using (window_id))"""

# The traffic rule's scores and the fused result of each window.
RESULTS_SQL = STATS_SQL + """,
scores as (
  select window_id as result_id, flow_key, window_at as ts_us, src_ip, dst_ip, least(1.0, cast(byte_count as double) / 50000.0) as anomaly,
    case when rst > 0 then least(1.0, 0.75 + cast(byte_count as double) / 100000.0) else 0.5 end as confidence, rst > 0 as resets
  from stats),
flags as (select *, anomaly > 0.8 as is_anomaly, resets and confidence > 0.7 as is_attack from scores),
risks as (
  select *, greatest(0.0, case when is_attack then confidence else 0 end, case when is_anomaly then anomaly else 0 end) as risk_score
  from flags),
results as materialized (
  select result_id, flow_key, ts_us, src_ip, dst_ip, anomaly as anomaly_score, confidence as classification_confidence,
    is_anomaly, is_attack, risk_score,
    case when is_attack and risk_score > 0.8 then 'attack' when is_anomaly and risk_score > 0.6 then 'suspicious' else 'normal' end as prediction,
    case when is_attack and risk_score > 0.8 then 'high' when is_anomaly and risk_score > 0.6 then 'medium' else 'low' end as severity
  from risks)"""


def http_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An HTTP log of two thirds of the connections; some rows name a connection nobody saw."""
    k = k_of_props()
    return table(spark, sf_dir, "events").filter(k % 3 != 0).select(
        F.concat(F.when(k % 11 == 0, "X").otherwise("C"), F.col("event_id").cast("string")).alias("uid"),
        F.get(F.array(*[F.lit(m) for m in ("GET", "POST", "PUT", "DELETE")]), (k % 4).cast("int")).alias("method"),
        F.concat(F.lit("/"), "event_type", F.lit("/"), k.cast("string")).alias("uri"),
        F.when(k % 5 != 0, F.when(k % 7 != 0, 200).otherwise(404)).alias("status"),
        F.concat(F.lit("agent"), (F.col("user_id") % 5).cast("string")).alias("user_agent"),
    )


def dns_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = k_of_props()
    return table(spark, sf_dir, "events").filter(k % 4 == 1).select(
        F.concat(F.lit("C"), F.col("event_id").cast("string")).alias("uid"),
        F.concat("event_type", (k % 6).cast("string"), F.lit(".example")).alias("query"), F.lit("A").alias("qtype"),
        F.when(k % 6 != 0, F.when(k % 5 == 0, "NXDOMAIN").otherwise("NOERROR")).alias("rcode"),
    )


# Both logs counted in the windows of their connections.
APPLICATION_SQL = CONTEXT_SQL + """,
http_log as (
  select 'C' || event_id as uid, ['GET', 'POST', 'PUT', 'DELETE'][k % 4 + 1] as method, '/' || event_type || '/' || k as uri,
    case when k % 5 <> 0 then case when k % 7 <> 0 then 200 else 404 end end as status, user_id % 5 as agent
  from base where k % 3 <> 0 and k % 11 <> 0),
dns_log as (
  select 'C' || event_id as uid, event_type || (k % 6) || '.example' as query,
    case when k % 6 <> 0 then case when k % 5 = 0 then 'NXDOMAIN' else 'NOERROR' end end as rcode from base where k % 4 = 1),
http as (
  select window_id, count(*) as requests, count(status) as responses, avg(length(uri)) as uri_length, count(distinct agent) as agents,
    count(case when method = 'GET' then 1 end) as n_get, count(case when method = 'POST' then 1 end) as n_post,
    count(case when method = 'PUT' then 1 end) as n_put, count(case when method = 'DELETE' then 1 end) as n_delete,
    count(case when status = 404 then 1 end) as not_found
  from http_log join windowed using (uid) group by 1),
dns as (
  select window_id, count(*) as queries, count(rcode) as answers, count(case when rcode = 'NXDOMAIN' then 1 end) / count(*) as nxdomain,
    avg(length(query)) as domain_length, count(distinct query) as domains
  from dns_log join windowed using (uid) group by 1),
applied as materialized (
  select f.*, coalesce(requests, 0) as requests, coalesce(responses, 0) as responses, coalesce(uri_length, 0) as uri_length,
    coalesce(agents, 0) as agents, coalesce(n_get, 0) as n_get, coalesce(n_post, 0) as n_post, coalesce(n_put, 0) as n_put,
    coalesce(n_delete, 0) as n_delete, coalesce(not_found, 0) as not_found, coalesce(queries, 0) as queries,
    coalesce(answers, 0) as answers, coalesce(nxdomain, 0) as nxdomain, coalesce(domain_length, 0) as domain_length,
    coalesce(domains, 0) as domains
  from features f left join http using (window_id) left join dns using (window_id))"""


def whitelist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").filter("n_regionkey = 1").select(
        F.concat(F.lit("10.0.0."), F.col("n_nationkey").cast("string")).alias("ip")
    )


def blacklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").filter("n_regionkey = 2").select(
        F.concat(F.lit("10.0.0."), F.col("n_nationkey").cast("string")).alias("ip")
    )


LISTS_SQL = """
whitelist as (select distinct '10.0.0.' || n_nationkey as ip from nation where n_regionkey = 1),
blacklist as (select distinct '10.0.0.' || n_nationkey as ip from nation where n_regionkey = 2)"""


def metric_columns(df: DataFrame) -> DataFrame:
    """Event rows as metric events: ten types and a missing one, labels missing now and then."""
    kinds = [
        "packet_processed", "feature_extracted", "inference_completed", "anomaly_detected", "attack_classified",
        "block_executed", "alert_generated", "error_occurred", "processing_latency", "custom_metric",
    ]
    df = df.withColumn("k", k_of_props()).withColumn("ts", F.col("ts").cast("timestamp"))
    k, user = F.col("k"), F.col("user_id")
    label = lambda prefix, n: F.concat(F.lit(prefix), (user % n).cast("string"))
    sometimes = lambda c: F.when(k % 3 != 0, c)
    return df.select(
        F.col("event_id").alias("id"), F.col("ts").alias("timestamp"),
        F.get(F.array(*[F.lit(x) for x in kinds]), (k % 11).cast("int")).alias("type"),
        sometimes(label("sensor", 3)).alias("source"), F.col("event_type").alias("protocol"),
        F.lit("flow").alias("feature_type"), sometimes(label("model", 2)).alias("model_name"),
        F.when(user % 2 == 0, "attack").otherwise("normal").alias("prediction"),
        sometimes(F.when(user % 4 == 0, "high").otherwise("medium")).alias("severity"),
        F.col("event_type").alias("attack_type"), label("policy", 3).alias("policy_name"),
        sometimes(F.lit("risk")).alias("reason"), label("component", 4).alias("component"),
        F.col("event_type").alias("error_type"), sometimes(label("operation", 2)).alias("operation"),
        F.when(k % 5 != 0, F.col("value") / 1000).alias("latency"),
    )


def metric_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric_columns(table(spark, sf_dir, "events"))


METRICS_SQL = """
base as (select *, cast(json_extract_string(props, '$.k') as bigint) as k from events),
metric_events as materialized (
  select event_id as id, epoch_us(ts) as ts_us,
    ['packet_processed', 'feature_extracted', 'inference_completed', 'anomaly_detected', 'attack_classified',
     'block_executed', 'alert_generated', 'error_occurred', 'processing_latency', 'custom_metric'][k % 11 + 1] as type,
    case when k % 3 <> 0 then 'sensor' || (user_id % 3) end as source, event_type as protocol, 'flow' as feature_type,
    case when k % 3 <> 0 then 'model' || (user_id % 2) end as model_name,
    case when user_id % 2 = 0 then 'attack' else 'normal' end as prediction,
    case when k % 3 <> 0 then case when user_id % 4 = 0 then 'high' else 'medium' end end as severity,
    event_type as attack_type, 'policy' || (user_id % 3) as policy_name, case when k % 3 <> 0 then 'risk' end as reason,
    'component' || (user_id % 4) as component, event_type as error_type,
    case when k % 3 <> 0 then 'operation' || (user_id % 2) end as operation,
    case when k % 5 <> 0 then value / 1000 end as latency
  from base)"""


def host_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.col("value")
    up_to = lambda c: F.least(F.lit(100.0), c)
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("timestamp"),
        up_to(value).alias("cpu_percent"), up_to(value * 1.5).alias("memory_percent"),
        up_to(value * 2).alias("disk_usage_percent"),
        F.array(value / 20, value / 40, value / 60).alias("load_average"),
        F.col("user_id").alias("host"),
    )


READINGS_SQL = """
readings as materialized (
  select event_id as id, epoch_us(ts) as ts_us, least(100.0, value) as cpu_percent, least(100.0, value * 1.5) as memory_percent,
    least(100.0, value * 2) as disk_usage_percent, value / 20 as load1, value / 40 as load5, value / 60 as load15, user_id as host
  from events)"""

# The moment the metric queries take as "now": the end of the last day of `events`.
NOW = 1_706_659_200 * SECOND
