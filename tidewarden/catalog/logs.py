"""Log parsing, packet headers, application logs, keyed messages and audit rows."""

from pyspark.sql import functions as F

from tidewarden.catalog.decisions import DECISION_COLUMNS, DECISION_SELECT, DECISIONS_SQL, decisions, results
from tidewarden.catalog.flows import features, r6
from tidewarden.catalog.metrics import ALERTS_SQL
from tidewarden.catalog.registry import query
from tidewarden.catalog.tables import CONTEXT_SQL, FLOWS_SQL, RESULTS_SQL, flows, host_readings, metric_events, table, with_sql
from tidewarden.functions.records import flow_key, micros, or_zero_dash
from tidewarden.operators import application, monitoring
from tidewarden.schemas import CONN_COLUMNS, EVE_SCHEMA, FEATURE_SCHEMA, RESULT_SCHEMA, FLOW_SCHEMA
from tidewarden.sinks.keyed import keyed_json
from tidewarden.session import run_dir
from tidewarden.sources.conn_log import conn_lines, read_conn_log, read_conn_rejects
from tidewarden.sources.eve_log import decode_json, event_messages, good_json, normalise_eve, read_eve_log, rejected_json
from tidewarden.sources.labelled import table_shape, training_table
from tidewarden.sources.packets import normalise_packets, packet_rows
from tidewarden.sources.streams import records_of, rejects_of, with_id


def written(spark, lines):
    """Lines as text files in the shared folder, as a sensor would leave them."""
    path = run_dir(spark, "log")
    lines.select("value").write.text(path)
    return path


def log_lines(spark, sf):
    """Connection log text with every kind of line: headers, short rows, bad numbers and dashes."""
    lines = conn_lines(flows(spark, sf))
    kind = F.col("record_id") % 20
    fields = F.split("value", "\t")
    dashed = F.transform(fields, lambda x, i: F.when(i.isin(9, 18), "-").otherwise(x))
    bad = F.transform(fields, lambda x, i: F.when(i == 9, "many").otherwise(x))
    return lines.withColumn("value", F.when(kind == 1, F.concat(F.lit("#"), "value"))
        .when(kind == 2, F.array_join(F.slice(fields, 1, 19), "\t"))
        .when(kind == 3, F.array_join(bad, "\t"))
        .when(kind == 4, F.array_join(dashed, "\t")).otherwise(F.col("value")))


@query("s1_conn_log", with_sql(FLOWS_SQL, """
select record_id, ts_us, uid, src_ip, src_port, dst_ip, dst_port, protocol, service, round(duration, 6) as duration,
  case when record_id % 20 = 4 then 0 else orig_bytes end as orig_bytes, resp_bytes, conn_state, local_orig, local_resp, missed_bytes, history,
  orig_pkts, orig_ip_bytes, case when record_id % 20 = 4 then 0 else resp_pkts end as resp_pkts, resp_ip_bytes
from flows where record_id % 20 not in (1, 2, 3)"""))
def _(spark, sf):
    rows = read_conn_log(spark, written(spark, log_lines(spark, sf)))
    return rows.select(F.substring("uid", 2, 20).cast("long").alias("record_id"), micros().alias("ts_us"), *[c for c in FLOW_SCHEMA.names if c not in ("ts", "duration")], r6("duration"))


@query("s1_conn_log_rejects", with_sql(FLOWS_SQL, """
select record_id, case when record_id % 20 = 2 then 'short line' else 'bad number' end as reject_reason from flows where record_id % 20 in (2, 3)"""))
def _(spark, sf):
    rejects = read_conn_rejects(spark, written(spark, log_lines(spark, sf)))
    return rejects.select(F.regexp_extract("line", r"\tC(\d+)\t", 1).cast("long").alias("record_id"), "reject_reason")


def eve_lines(spark, sf):
    f = flows(spark, sf)
    flow = F.struct(F.col("orig_pkts").alias("pkts_toserver"), F.col("resp_pkts").alias("pkts_toclient"),
                    F.col("orig_bytes").alias("bytes_toserver"), F.col("resp_bytes").alias("bytes_toclient"))
    event = F.struct(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxx").alias("timestamp"), F.col("service").alias("event_type"),
        F.when(F.col("src_port") > 1024, F.col("src_ip")).alias("src_ip"), "src_port", F.col("dst_ip").alias("dest_ip"),
        F.col("dst_port").alias("dest_port"), F.upper("protocol").alias("proto"), F.col("record_id").alias("flow_id"), flow.alias("flow"))
    text = F.to_json(event)
    return f.select("record_id", F.when(F.col("record_id") % 25 == 3, F.substring(text, 1, 60)).otherwise(text).alias("value"))


@query("s2_eve_log", with_sql(FLOWS_SQL, """
select record_id, ts_us, case when src_port > 1024 then src_ip else '' end as src_ip, src_port, dst_ip, dst_port, protocol, service, orig_bytes, resp_bytes,
  orig_pkts, resp_pkts, case when src_port > 1024 then src_ip else 'unknown' end as key from flows where record_id % 25 <> 3"""))
def _(spark, sf):
    """Sensor events decoded, normalised to flow records, with the message key of the raw event."""
    events = read_eve_log(spark, written(spark, eve_lines(spark, sf))).withColumns(
        {"record_id": F.col("flow_id"), "key": F.coalesce("src_ip", F.lit("unknown"))})
    return normalise_eve(events, ("record_id", "key")).select(
        "record_id", micros().alias("ts_us"), "src_ip", "src_port", "dst_ip", "dst_port", "protocol", "service",
        "orig_bytes", "resp_bytes", "orig_pkts", "resp_pkts", "key")


@query("s2_eve_rejects", with_sql(FLOWS_SQL, "select count(*) as rejects, 'not JSON' as reject_reason from flows where record_id % 25 = 3"))
def _(spark, sf):
    return rejected_json(decode_json(eve_lines(spark, sf), EVE_SCHEMA)).groupBy("reject_reason").agg(F.count(F.lit(1)).alias("rejects"))


def packet_headers(spark, sf):
    f = flows(spark, sf)
    number = F.when(F.col("protocol") == "tcp", 6).when(F.col("protocol") == "udp", 17).when(F.col("conn_state") == "SF", 47).otherwise(1)
    return f.select("record_id", "ts", F.when(F.col("record_id") % 30 != 5, 4).alias("ip_version"), "src_ip", "dst_ip", number.alias("ip_proto"),
                    "src_port", "dst_port", (F.col("record_id") % 64).cast("int").alias("tcp_flags"), F.col("orig_bytes").alias("packet_size"))


PACKETS_SQL = FLOWS_SQL + """,
packets as (
  select record_id, ts_us, src_ip, dst_ip, case when protocol in ('tcp', 'udp') then src_port else 0 end as src_port,
    case when protocol in ('tcp', 'udp') then dst_port else 0 end as dst_port,
    case when protocol = 'tcp' then 'TCP' when protocol = 'udp' then 'UDP' when conn_state = 'SF' then '47' else 'ICMP' end as protocol,
    orig_bytes as packet_size, record_id % 64 as bits from flows where record_id % 30 <> 5)"""


@query("s9_packets", with_sql(PACKETS_SQL, "select record_id, ts_us, src_ip, dst_ip, src_port, dst_port, protocol, packet_size from packets"))
def _(spark, sf):
    return packet_rows(packet_headers(spark, sf)).select("record_id", micros().alias("ts_us"), "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "packet_size")


@query("x9_tcp_flag_bits", with_sql(PACKETS_SQL, """
select record_id, bits & 2 <> 0 as "SYN", bits & 16 <> 0 as "ACK", bits & 1 <> 0 as "FIN", bits & 4 <> 0 as "RST", bits & 8 <> 0 as "PSH", bits & 32 <> 0 as "URG"
from packets where protocol = 'TCP'"""))
def _(spark, sf):
    p = packet_rows(packet_headers(spark, sf)).filter("flags is not null")
    return p.select("record_id", *[F.col("flags")[n].alias(n) for n in ("SYN", "ACK", "FIN", "RST", "PSH", "URG")])


@query("x10_protocol_names", with_sql(PACKETS_SQL, "select protocol, count(*) as packets, count(case when src_port = 0 then 1 end) as without_port from packets group by 1"))
def _(spark, sf):
    return packet_rows(packet_headers(spark, sf)).groupBy("protocol").agg(
        F.count(F.lit(1)).alias("packets"), F.count(F.when(F.col("src_port") == 0, 1)).alias("without_port"))


@query("s9_packets_as_flows", with_sql(PACKETS_SQL, """
select record_id, src_ip || ':' || src_port || '-' || dst_ip || ':' || dst_port as flow_key, lower(protocol) as protocol, packet_size as orig_bytes,
  case when protocol = 'TCP' then case when bits & 2 <> 0 then 'S' else '' end || case when bits & 16 <> 0 then 'A' else '' end ||
    case when bits & 1 <> 0 then 'F' else '' end || case when bits & 4 <> 0 then 'R' else '' end || case when bits & 8 <> 0 then 'P' else '' end ||
    case when bits & 32 <> 0 then 'U' else '' end else '' end as history from packets"""))
def _(spark, sf):
    n = normalise_packets(packet_rows(packet_headers(spark, sf)))
    return n.select("record_id", flow_key().alias("flow_key"), "protocol", "orig_bytes", "history")


@query("x1_text_functions", with_sql(FLOWS_SQL, """
select record_id, starts_with(src_ip, '10.') as is_local, trim('  ' || service || ' ') as service, string_split(dst_ip, '.')[4] as last_part,
  concat_ws('/', protocol, service, conn_state) as joined from flows"""))
def _(spark, sf):
    return flows(spark, sf).select("record_id", F.startswith("src_ip", F.lit("10.")).alias("is_local"), F.trim(F.concat(F.lit("  "), "service", F.lit(" "))).alias("service"),
        F.element_at(F.split("dst_ip", r"\."), 4).alias("last_part"), F.concat_ws("/", "protocol", "service", "conn_state").alias("joined"))


@query("x4_time_arithmetic", with_sql(FLOWS_SQL, """
select record_id, ts_us + 300000000 as expires_at, ts_us + 300000000 <= 1705000000000000 as expired from flows"""))
def _(spark, sf):
    expires = F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(300))
    return flows(spark, sf).select("record_id", F.unix_micros(expires).alias("expires_at"), (expires <= F.timestamp_seconds(F.lit(1705000000))).alias("expired"))


@query("x7_json_round_trip", with_sql(FLOWS_SQL, "select record_id, src_ip, orig_bytes, round(duration, 6) as duration, local_orig from flows"))
def _(spark, sf):
    text = flows(spark, sf).select("record_id", F.to_json(F.struct("src_ip", "orig_bytes", "duration", "local_orig")).alias("value"))
    return good_json(decode_json(text, FLOW_SCHEMA)).select("record_id", "src_ip", "orig_bytes", r6("duration"), "local_orig")


@query("x8_dash_numbers", with_sql(FLOWS_SQL, """
select record_id, case when history = '-' then 0 when history = 'S0R' then null else 42 end as number from flows"""))
def _(spark, sf):
    text = F.when(F.col("history") == "-", "-").when(F.col("history") == "S0R", "S0R").otherwise("42")
    return flows(spark, sf).select("record_id", or_zero_dash(text, "int").alias("number"))


HTTP_SQL = """
http_log as (
  select regexp_extract(url, '^https?://([^/]+)', 1) as host, ['GET', 'POST', 'PUT', 'DELETE'][page_id % 4 + 1] as method,
    regexp_replace(url, '^https?://[^/]+', '') as uri, case when page_id % 6 <> 0 then [200, 301, 404, 500][page_id % 4 + 1] end as status,
    'agent' || (page_id % 3) as user_agent from pages)"""


def http_log(spark, sf):
    n = F.col("page_id")
    pick = lambda *xs: F.get(F.array(*[F.lit(x) for x in xs]), (n % len(xs)).cast("int"))
    return table(spark, sf, "pages").select(
        F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"), pick("GET", "POST", "PUT", "DELETE").alias("method"),
        F.regexp_replace("url", "^https?://[^/]+", "").alias("uri"), F.when(n % 6 != 0, pick(200, 301, 404, 500)).alias("status"),
        F.concat(F.lit("agent"), (n % 3).cast("string")).alias("user_agent"))


@query("a7_http_features", f"""with {HTTP_SQL}
select host, count(*) as request_count, count(status) as response_count, round(avg(length(uri)), 6) as avg_uri_length, count(distinct user_agent) as unique_user_agents,
  count(case when status = 200 then 1 end) as ok, count(case when status = 404 then 1 end) as not_found, count(case when method = 'GET' then 1 end) as "GET",
  count(case when method = 'POST' then 1 end) as "POST" from http_log group by 1""")
def _(spark, sf):
    h = application.http_features(http_log(spark, sf), ["host"])
    of = lambda c, k: F.coalesce(F.try_element_at(c, F.lit(k)), F.lit(0))
    return h.select("host", "request_count", "response_count", r6("avg_uri_length"), "unique_user_agents", of("status_codes", "200").alias("ok"),
                    of("status_codes", "404").alias("not_found"), of("methods", "GET").alias("GET"), of("methods", "POST").alias("POST"))


DNS_SQL = HTTP_SQL + """,
dns_log as (
  select 'client' || (page_id % 9) as client, regexp_extract(url, '^https?://([^/]+)', 1) as query, ['A', 'AAAA', 'MX'][page_id % 3 + 1] as qtype,
    case when page_id % 7 <> 0 then case when page_id % 5 = 0 then 'NXDOMAIN' else 'NOERROR' end end as rcode from pages)"""


@query("a8_dns_features", f"""with {DNS_SQL}
select client, count(*) as query_count, count(rcode) as response_count, round(count(case when rcode = 'NXDOMAIN' then 1 end) / count(*), 6) as nxdomain_ratio,
  round(avg(length(query)), 6) as avg_domain_length, count(distinct query) as unique_domains, count(case when qtype = 'A' then 1 end) as a_queries from dns_log group by 1""")
def _(spark, sf):
    n = F.col("page_id")
    log = table(spark, sf, "pages").select(
        F.concat(F.lit("client"), (n % 9).cast("string")).alias("client"), F.regexp_extract("url", "^https?://([^/]+)", 1).alias("query"),
        F.get(F.array(F.lit("A"), F.lit("AAAA"), F.lit("MX")), (n % 3).cast("int")).alias("qtype"),
        F.when(n % 7 != 0, F.when(n % 5 == 0, "NXDOMAIN").otherwise("NOERROR")).alias("rcode"))
    d = application.dns_features(log, ["client"])
    return d.select("client", "query_count", "response_count", r6("nxdomain_ratio"), r6("avg_domain_length"), "unique_domains",
                    F.coalesce(F.try_element_at("query_types", F.lit("A")), F.lit(0)).alias("a_queries"))


@query("k1_network_messages", with_sql(FLOWS_SQL, "select src_ip as key, record_id, uid, ts_us, orig_bytes, resp_bytes, history from flows"))
def _(spark, sf):
    """Connection rows as keyed messages, decoded again."""
    sent = keyed_json(flows(spark, sf), "src_ip")
    return records_of(sent, with_id(FLOW_SCHEMA, "record_id")).select("key", "record_id", "uid", micros().alias("ts_us"), "orig_bytes", "resp_bytes", "history")


@query("k1_packet_messages", with_sql(PACKETS_SQL, """
select src_ip as key, record_id, ts_us, dst_ip, src_port, protocol, packet_size, bits & 2 <> 0 and protocol = 'TCP' as syn from packets"""))
def _(spark, sf):
    """Packets as keyed messages, decoded again."""
    rows = packet_rows(packet_headers(spark, sf))
    got = keyed_json(rows, "src_ip").select("key", F.from_json("value", rows.schema).alias("p")).select("key", "p.*")
    syn = F.coalesce(F.try_element_at("flags", F.lit("SYN")), F.lit(False)).alias("syn")
    return got.select("key", "record_id", micros().alias("ts_us"), "dst_ip", "src_port", "protocol", "packet_size", syn)


@query("k1_event_messages", with_sql(FLOWS_SQL, """
select case when src_port > 1024 then src_ip else 'unknown' end as key, record_id, service as event_type, dst_port as dest_port, orig_bytes as bytes_toserver
from flows where record_id % 25 <> 3"""))
def _(spark, sf):
    """Raw sensor events as keyed messages, decoded again; those without a source have the key ``unknown``."""
    events = read_eve_log(spark, written(spark, eve_lines(spark, sf)))
    got = good_json(decode_json(event_messages(events), EVE_SCHEMA))
    return got.select("key", F.col("flow_id").alias("record_id"), "event_type", "dest_port", F.col("flow.bytes_toserver").alias("bytes_toserver"))


@query("k2_feature_messages", with_sql(CONTEXT_SQL, """
select src_ip as key, window_id, byte_count, round(entropy, 6) as entropy, syn as "SYN", recent_flows, unique_dst_ips from features"""))
def _(spark, sf):
    sent = keyed_json(features(spark, sf), "src_ip")
    got = records_of(sent, with_id(FEATURE_SCHEMA, "window_id"))
    return got.select("key", "window_id", "byte_count", r6("entropy"), F.try_element_at("tcp_flags", F.lit("SYN")).alias("SYN"), "recent_flows", "unique_dst_ips")


@query("k3_result_messages", with_sql(RESULTS_SQL, """
select src_ip as key, result_id, prediction, severity, round(risk_score, 6) as risk_score, is_anomaly, is_attack from results"""))
def _(spark, sf):
    sent = keyed_json(results(spark, sf).select("result_id", *RESULT_SCHEMA.names), "src_ip")
    got = records_of(sent, with_id(RESULT_SCHEMA, "result_id"))
    return got.select("key", "result_id", "prediction", "severity", r6("risk_score"), "is_anomaly", "is_attack")


@query("k4_decision_messages", with_sql(DECISIONS_SQL, "select src_ip as key, " + DECISION_SELECT.strip().removeprefix("select").replace("ts_us, ", "")))
def _(spark, sf):
    d = decisions(spark, sf)
    got = keyed_json(d, "src_ip").select("key", F.from_json("value", d.schema).alias("d")).select("key", "d.*")
    return got.select("key", *DECISION_COLUMNS, r6("risk_score"))


@query("k6_alert_messages", f"with {ALERTS_SQL} select 'system' as key, id, type, severity, round(value, 6) as value from host_alerts")
def _(spark, sf):
    a = monitoring.host_alerts(host_readings(spark, sf))
    return keyed_json(a, F.lit("system")).select("key", F.from_json("value", a.schema).alias("a")).select("key", "a.id", "a.type", "a.severity", F.round("a.value", 6).alias("value"))


@query("t9_message_rejects", with_sql(FLOWS_SQL, """
select case when record_id % 40 = 1 then 'not JSON' else 'no src_ip' end as reject_reason, count(*) as messages from flows where record_id % 40 in (1, 2) group by 1"""))
def _(spark, sf):
    """Undecodable and incomplete messages go to the rejects with their reason; the others are untouched."""
    kind = F.col("record_id") % 40
    f = flows(spark, sf).withColumn("src_ip", F.when(kind != 2, F.col("src_ip")))
    lines = f.select(F.when(kind == 1, "{broken").otherwise(F.to_json(F.struct("*"))).alias("value"))
    return rejects_of(lines, FLOW_SCHEMA, ("src_ip",)).groupBy("reject_reason").agg(F.count(F.lit(1)).alias("messages"))
