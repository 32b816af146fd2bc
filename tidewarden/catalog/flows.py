"""Flow windows, their features and host context."""

from pyspark.sql import functions as F

from tidewarden.catalog.registry import query
from tidewarden.catalog.tables import (
    APPLICATION_SQL, CAP, CONTEXT_SQL, DAY, FLOWS_SQL, HOUR, STATS_SQL, WIDTH, dns_records, flows, http_records, windows_sql,
    with_sql,
)
from tidewarden.functions.records import day_of_week, flow_key, letters, micros, or_default, time_of_day, total_bytes, total_packets
from tidewarden.functions.text import character_entropy
from tidewarden.functions.vector import feature_vector
from tidewarden.operators import hosts
from tidewarden.operators.flows import WINDOW_KEY, feature_record, flow_features, flow_windows, window_statistics
from tidewarden.schemas import TEXT_COLUMNS


def windowed(spark, sf, width=WIDTH, cap=CAP):
    return flow_windows(flows(spark, sf), width, cap)


def stats(spark, sf, text=False):
    return window_statistics(windowed(spark, sf), text)


def features(spark, sf):
    return flow_features(flows(spark, sf), WIDTH, CAP)


def r6(column):
    return F.round(column, 6).alias(column if isinstance(column, str) else "value")


@query("p1_flow_key", with_sql(FLOWS_SQL, """
select record_id, src_ip || ':' || src_port || '-' || dst_ip || ':' || dst_port as flow_key from flows"""))
def _(spark, sf):
    return flows(spark, sf).select("record_id", flow_key().alias("flow_key"))


@query("p2_record_totals", with_sql(FLOWS_SQL, """
select record_id, orig_bytes + resp_bytes as total_bytes, orig_pkts + resp_pkts as total_packets from flows"""))
def _(spark, sf):
    return flows(spark, sf).select("record_id", total_bytes().alias("total_bytes"), total_packets().alias("total_packets"))


@query("p3_nonempty_keys", with_sql(FLOWS_SQL, """
select src_ip, count(*) as records, count(case when dst_port <> 0 then 1 end) as port_records from flows
where src_ip <> '' group by 1"""))
def _(spark, sf):
    known = F.count(F.when(or_default("dst_port", 0) != 0, 1))
    return hosts.host_records(flows(spark, sf)).groupBy("src_ip").agg(F.count(F.lit(1)).alias("records"), known.alias("port_records"))


@query("p4_default_fill", with_sql(FLOWS_SQL, """
select record_id, coalesce(nullif(src_ip, '10.0.0.3'), '') as src_ip, coalesce(nullif(dst_port, 22), 0) as dst_port,
  coalesce(nullif(protocol, 'icmp'), 'unknown') as protocol from flows"""))
def _(spark, sf):
    f = flows(spark, sf).withColumns({
        "src_ip": F.nullif("src_ip", F.lit("10.0.0.3")), "dst_port": F.nullif("dst_port", F.lit(22)),
        "protocol": F.nullif("protocol", F.lit("icmp")),
    })
    return f.select("record_id", or_default("src_ip", "").alias("src_ip"), or_default("dst_port", 0).alias("dst_port"),
                    or_default("protocol", "unknown").alias("protocol"))


@query("w1_flow_windows", with_sql(windows_sql(), "select record_id, flow_key, window_at, window_id from windowed"))
def _(spark, sf):
    return windowed(spark, sf).select("record_id", "flow_key", "window_at", "window_id")


@query("w1_flow_windows_capped", with_sql(windows_sql(DAY, 3), "select record_id, flow_key, window_at, window_id from windowed"))
def _(spark, sf):
    return windowed(spark, sf, DAY, 3).select("record_id", "flow_key", "window_at", "window_id")


@query("w1_flow_windows_hot_keys", with_sql(windows_sql(6 * HOUR, 2), "select record_id, flow_key, window_at, window_id from windowed"))
def _(spark, sf):
    """Every key above 20 records goes the way of hot keys, in blocks of 25 records."""
    return flow_windows(flows(spark, sf), 6 * HOUR, 2, hot_rows=20, block_rows=25).select("record_id", "flow_key", "window_at", "window_id")


@query("a1_flow_totals", with_sql(STATS_SQL, "select flow_key, window_id, byte_count, packet_count, record_count from stats"))
def _(spark, sf):
    return stats(spark, sf).select("flow_key", "window_id", "byte_count", "packet_count", "record_count")


@query("a2_flow_duration", with_sql(STATS_SQL, "select flow_key, window_id, round(duration, 6) as duration from stats"))
def _(spark, sf):
    return stats(spark, sf).select("flow_key", "window_id", r6("duration"))


@query("a3_first_record", with_sql(STATS_SQL, "select flow_key, window_id, src_ip, src_port, dst_ip, dst_port, protocol, first_at from stats"))
def _(spark, sf):
    return stats(spark, sf).select("flow_key", "window_id", "src_ip", "src_port", "dst_ip", "dst_port", "protocol", "first_at")


@query("a4_rates", with_sql(STATS_SQL, """
select flow_key, window_id, round(packets_per_second, 6) as packets_per_second, round(bytes_per_second, 6) as bytes_per_second from stats"""))
def _(spark, sf):
    return stats(spark, sf).select("flow_key", "window_id", r6("packets_per_second"), r6("bytes_per_second"))


@query("a5_packet_sizes", with_sql(STATS_SQL, """
select flow_key, window_id, round(avg_packet_size, 6) as avg_packet_size, round(std_packet_size, 6) as std_packet_size,
  round(min_packet_size, 6) as min_packet_size, round(max_packet_size, 6) as max_packet_size from stats"""))
def _(spark, sf):
    return stats(spark, sf).select("flow_key", "window_id", *[r6(f"{n}_packet_size") for n in ("avg", "std", "min", "max")])


@query("a6_tcp_flags", with_sql(STATS_SQL, """select flow_key, window_id, syn as "SYN", ack as "ACK", fin as "FIN", rst as "RST", psh as "PSH", urg as "URG" from stats"""))
def _(spark, sf):
    return stats(spark, sf).select("flow_key", "window_id", "SYN", "ACK", "FIN", "RST", "PSH", "URG")


@query("a9_entropy", with_sql(STATS_SQL, "select flow_key, window_id, round(entropy, 6) as entropy from stats"))
def _(spark, sf):
    return character_entropy(windowed(spark, sf), WINDOW_KEY, TEXT_COLUMNS).select("flow_key", "window_id", r6("entropy"))


@query("a9_entropy_per_host", with_sql(FLOWS_SQL, """,
c as (select src_ip, unnest(string_split(uid || src_ip || dst_ip || protocol || service || conn_state || history, '')) as c from flows),
n as (select src_ip, c, count(*) as n from c group by 1, 2)
select src_ip, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6) as entropy from n group by 1"""))
def _(spark, sf):
    """Groups without a record cap: a hot host sends at most its alphabet from each task."""
    return character_entropy(flows(spark, sf), ["src_ip"], TEXT_COLUMNS).select("src_ip", r6("entropy"))


@query("a10_distinct_destinations", with_sql(FLOWS_SQL, """
select f.record_id, f.src_ip, count(distinct g.dst_ip) as unique_dst_ips,
  count(distinct case when g.dst_port <> 0 then g.dst_port end) as unique_dst_ports
from flows f join flows g on g.src_ip = f.src_ip and g.ts_us <= f.ts_us group by 1, 2"""))
def _(spark, sf):
    return hosts.distinct_so_far(flows(spark, sf)).select("record_id", "src_ip", "unique_dst_ips", "unique_dst_ports")


@query("a10_distinct_per_host", with_sql(FLOWS_SQL, """
select src_ip, count(distinct dst_ip) as unique_dst_ips, count(distinct case when dst_port <> 0 then dst_port end) as unique_dst_ports
from flows group by 1"""))
def _(spark, sf):
    return hosts.destination_counts(flows(spark, sf))


RECENT_SQL = f"""
select f.record_id, f.src_ip, count(*) as recent_flows, cast(sum(g.orig_bytes + g.resp_bytes) as bigint) as recent_bytes,
  cast(sum(g.orig_pkts + g.resp_pkts) as bigint) as recent_packets
from flows f join flows g on g.src_ip = f.src_ip and g.ts_us > f.ts_us - {WIDTH} and g.ts_us <= f.ts_us group by 1, 2"""


@query("w2_trailing_window", with_sql(FLOWS_SQL, RECENT_SQL))
def _(spark, sf):
    return hosts.trailing_totals(flows(spark, sf), WIDTH).select("record_id", "src_ip", *hosts.RECENT)


@query("a11_recent_activity", with_sql(CONTEXT_SQL, "select flow_key, window_id, recent_flows, recent_bytes, recent_packets from features"))
def _(spark, sf):
    s = stats(spark, sf)
    return hosts.host_context(flows(spark, sf), s, WINDOW_KEY, WIDTH).select("flow_key", "window_id", *hosts.RECENT)


@query("a11_bounded_history", with_sql(STATS_SQL, f""",
seen as (
  select s.flow_key, s.window_id, s.first_at, f.* from stats s join flows f on f.src_ip = s.src_ip and f.ts_us <= s.last_at
  qualify row_number() over (partition by s.window_id order by f.ts_us desc, f.record_id desc) <= 20)
select flow_key, window_id, count(*) as recent_flows, cast(sum(orig_bytes + resp_bytes) as bigint) as recent_bytes,
  cast(sum(orig_pkts + resp_pkts) as bigint) as recent_packets from seen where ts_us > first_at - {WIDTH} group by 1, 2"""))
def _(spark, sf):
    """Only a host's newest 20 records count as recent."""
    s = stats(spark, sf)
    return hosts.host_context(flows(spark, sf), s, WINDOW_KEY, WIDTH, max_history=20).select("flow_key", "window_id", *hosts.RECENT)


@query("j6_trailing_join", with_sql(CONTEXT_SQL, "select window_id, src_ip, recent_flows, recent_bytes from features"))
def _(spark, sf):
    s = stats(spark, sf)
    return hosts.host_context(flows(spark, sf), s, WINDOW_KEY, WIDTH).select("window_id", "src_ip", "recent_flows", "recent_bytes")


@query("j1_host_state", with_sql(STATS_SQL, """,
h as (select src_ip, count(distinct dst_ip) as unique_dst_ips, count(distinct case when dst_port <> 0 then dst_port end) as unique_dst_ports
  from flows group by 1)
select flow_key, window_id, unique_dst_ips, unique_dst_ports from stats left join h using (src_ip)"""))
def _(spark, sf):
    return stats(spark, sf).join(hosts.destination_counts(flows(spark, sf)), "src_ip", "left").select(
        "flow_key", "window_id", "unique_dst_ips", "unique_dst_ports")


@query("w3_bounded_history", with_sql(FLOWS_SQL, """
select record_id, src_ip, ts_us from flows
qualify row_number() over (partition by src_ip order by ts_us desc, record_id desc) <= 100"""))
def _(spark, sf):
    f = flows(spark, sf).select("record_id", "src_ip", micros().alias("ts_us"))
    return hosts.last_per_key(f, ["src_ip"], ["ts_us", "record_id"], 100)


@query("l1_sorted_records", with_sql(windows_sql(), """
select record_id, window_id, row_number() over (partition by flow_key, window_id order by ts_us, record_id) as position from windowed"""))
def _(spark, sf):
    members = F.array_sort(F.collect_list(F.struct("at", "record_id")))
    return windowed(spark, sf).groupBy(*WINDOW_KEY).agg(members.alias("m")).select("window_id", F.posexplode("m")).select(
        "col.record_id", "window_id", (F.col("pos") + 1).cast("long").alias("position"))


@query("x2_text_counts", with_sql(FLOWS_SQL, """
select record_id, length(history) - length(replace(history, 'A', '')) as ack_letters, contains(history, 'R') as has_reset,
  regexp_replace(src_ip, '^10\\.', '') as short_ip from flows"""))
def _(spark, sf):
    return flows(spark, sf).select("record_id", letters("history", "A").alias("ack_letters"),
        F.contains("history", F.lit("R")).alias("has_reset"), F.regexp_replace("src_ip", r"^10\.", "").alias("short_ip"))


@query("x3_time_features", with_sql(FLOWS_SQL, """
select record_id, round(extract(hour from make_timestamp(ts_us)) + extract(minute from make_timestamp(ts_us)) / 60.0, 6) as time_of_day,
  cast(extract(isodow from make_timestamp(ts_us)) - 1 as integer) as day_of_week from flows"""))
def _(spark, sf):
    return flows(spark, sf).select("record_id", F.round(time_of_day("ts"), 6).alias("time_of_day"), day_of_week("ts").alias("day_of_week"))


@query("x5_math", with_sql(FLOWS_SQL, """
select src_ip, round(avg(duration), 6) as mean, round(stddev_pop(duration), 6) as deviation, min(duration) as smallest, max(duration) as largest,
  round(log2(cast(sum(orig_pkts) as double)), 6) as bits, round(least(greatest(max(duration) / 20, 0), 1), 6) as clamped,
  round(case when sum(resp_pkts) > 0 then sum(resp_bytes) / sum(resp_pkts) else 0 end, 6) as ratio from flows group by 1"""))
def _(spark, sf):
    from tidewarden.functions.records import clamp01
    ratio = F.when(F.sum("resp_pkts") > 0, F.sum("resp_bytes") / F.sum("resp_pkts")).otherwise(0.0)
    return flows(spark, sf).groupBy("src_ip").agg(
        F.round(F.avg("duration"), 6).alias("mean"), F.round(F.stddev_pop("duration"), 6).alias("deviation"),
        F.min("duration").alias("smallest"), F.max("duration").alias("largest"),
        F.round(F.log2(F.sum("orig_pkts").cast("double")), 6).alias("bits"),
        F.round(clamp01(F.max("duration") / 20), 6).alias("clamped"), F.round(ratio, 6).alias("ratio"))


@query("x6_maps_and_arrays", with_sql(STATS_SQL, """select window_id, cast(6 as integer) as flags, syn as "SYN", cast(null as bigint) as "ECE" from stats"""))
def _(spark, sf):
    f = feature_record(stats(spark, sf, text=True).withColumns({n: F.lit(0) for n in (*hosts.DISTINCT, *hosts.RECENT)}))
    return f.select("window_id", F.size("tcp_flags").alias("flags"), F.try_element_at("tcp_flags", F.lit("SYN")).alias("SYN"),
                    F.try_element_at("tcp_flags", F.lit("ECE")).alias("ECE"))


FEATURE_SELECT = """
select flow_key, window_id, src_ip, dst_ip, src_port, dst_port, protocol, first_at as ts_us, round(duration, 6) as duration,
  packet_count, byte_count, round(packets_per_second, 6) as packets_per_second, round(bytes_per_second, 6) as bytes_per_second,
  round(avg_packet_size, 6) as avg_packet_size, round(std_packet_size, 6) as std_packet_size,
  round(min_packet_size, 6) as min_packet_size, round(max_packet_size, 6) as max_packet_size,
  syn as "SYN", ack as "ACK", fin as "FIN", rst as "RST", psh as "PSH", urg as "URG", round(time_of_day, 6) as time_of_day, day_of_week,
  round(entropy, 6) as entropy, unique_dst_ports, unique_dst_ips, recent_flows, recent_bytes, recent_packets from features"""


@query("p5_feature_record", with_sql(CONTEXT_SQL, FEATURE_SELECT))
def _(spark, sf):
    flags = [F.try_element_at("tcp_flags", F.lit(n)).alias(n) for n in ("SYN", "ACK", "FIN", "RST", "PSH", "URG")]
    return features(spark, sf).select(
        "flow_key", "window_id", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", micros("timestamp").alias("ts_us"),
        r6("duration"), "packet_count", "byte_count", r6("packets_per_second"), r6("bytes_per_second"), r6("avg_packet_size"),
        r6("std_packet_size"), r6("min_packet_size"), r6("max_packet_size"), *flags, r6("time_of_day"), "day_of_week", r6("entropy"),
        "unique_dst_ports", "unique_dst_ips", "recent_flows", "recent_bytes", "recent_packets")


VECTOR_SQL = """,
vectors as (
  select window_id, [duration, packet_count, byte_count, packets_per_second, bytes_per_second, avg_packet_size, std_packet_size,
    min_packet_size, max_packet_size, time_of_day, day_of_week, entropy, unique_dst_ports, unique_dst_ips, recent_flows, recent_bytes,
    recent_packets, syn, ack, fin, rst, psh, urg, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0] as v from features)
select window_id, cast(unnest(range(36)) as integer) as pos, round(cast(cast(unnest(v) as float) as double), 2) as entry from vectors"""


@query("p6_feature_vector", with_sql(CONTEXT_SQL, VECTOR_SQL))
def _(spark, sf):
    return feature_vector(features(spark, sf)).select("window_id", F.posexplode("vector")).select(
        "window_id", "pos", F.round(F.col("col").cast("double"), 2).alias("entry"))


def features_with_logs(spark, sf):
    return flow_features(flows(spark, sf), WIDTH, CAP, http=http_records(spark, sf), dns=dns_records(spark, sf))


@query("p5_application_features", with_sql(APPLICATION_SQL, """
select window_id, byte_count, recent_flows, requests, responses, not_found, round(uri_length, 6) as uri_length, agents, n_get, n_post, n_put,
  n_delete, queries, answers, round(nxdomain, 6) as nxdomain, round(domain_length, 6) as domain_length, domains from applied"""))
def _(spark, sf):
    """The feature record with HTTP and DNS logs joined to the windows of their connections."""
    http, dns = (lambda c: F.col(f"http_features.{c}")), (lambda c: F.col(f"dns_features.{c}"))
    of = lambda c, k: F.coalesce(F.try_element_at(http(c), F.lit(k)), F.lit(0))
    return features_with_logs(spark, sf).select(
        "window_id", "byte_count", "recent_flows", http("request_count").alias("requests"), http("response_count").alias("responses"),
        of("status_codes", "404").alias("not_found"), F.round(http("avg_uri_length"), 6).alias("uri_length"),
        http("unique_user_agents").alias("agents"), *[of("methods", m).alias(f"n_{m.lower()}") for m in ("GET", "POST", "PUT", "DELETE")],
        dns("query_count").alias("queries"), dns("response_count").alias("answers"), F.round(dns("nxdomain_ratio"), 6).alias("nxdomain"),
        F.round(dns("avg_domain_length"), 6).alias("domain_length"), dns("unique_domains").alias("domains"))


@query("p6_application_vector", with_sql(APPLICATION_SQL, """,
vectors as (
  select window_id, [requests, responses, uri_length, agents, n_get, n_post, n_put, n_delete, queries, answers, nxdomain, domain_length,
    domains] as v from applied)
select window_id, cast(unnest(range(23, 36)) as integer) as pos, round(cast(cast(unnest(v) as float) as double), 2) as entry from vectors"""))
def _(spark, sf):
    """The vector's application entries (23 to 35), which only windows with such logs fill."""
    v = feature_vector(features_with_logs(spark, sf)).select("window_id", F.posexplode("vector"))
    return v.filter("pos >= 23").select("window_id", "pos", F.round(F.col("col").cast("double"), 2).alias("entry"))


@query("p7_numeric_guard", with_sql(FLOWS_SQL, """
select record_id, cast(unnest([0, 2]) as integer) as pos, unnest([round(cast(cast(duration as float) as double), 4), 0.0]) as entry from flows"""))
def _(spark, sf):
    """A textual flow entry counts as 0; the others keep their value."""
    f = flows(spark, sf).select("record_id", "duration", F.col("uid").alias("byte_count"))
    return feature_vector(f).select("record_id", F.posexplode("vector")).filter("pos in (0, 2)").select(
        "record_id", "pos", F.round(F.col("col").cast("double"), 4).alias("entry"))


@query("p8_zero_vector", with_sql(FLOWS_SQL, """
select record_id, round(case when history = '-' then 0 else cast(cast(duration as float) as double) end, 4) as duration,
  case when history = '-' then 0.0 else 2.0 end as syn from flows"""))
def _(spark, sf):
    """An unreadable nested value makes the whole vector zero."""
    text = F.when(F.col("history") == "-", "none").otherwise("2")
    f = flows(spark, sf).select("record_id", "duration", F.create_map(F.lit("SYN"), text).alias("tcp_flags"))
    v = feature_vector(f)
    return v.select("record_id", F.round(F.get("vector", F.lit(0)).cast("double"), 4).alias("duration"),
                    F.get("vector", F.lit(17)).cast("double").alias("syn"))


@query("u1_distinct_pairs", with_sql(FLOWS_SQL, "select src_ip, dst_ip, min(ts_us) as first_at from flows group by 1, 2"))
def _(spark, sf):
    return hosts.first_contacts(flows(spark, sf)).filter("kind = 'unique_dst_ips'").select(
        "src_ip", F.col("dst").alias("dst_ip"), F.col("at").alias("first_at"))
