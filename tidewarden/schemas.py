"""Record schemas shared by sources, operators and streams."""

from pyspark.sql import types as T


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


S, L, I, D, B = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.BooleanType()
COUNTS = T.MapType(S, L)

# The column order of a connection log line.
CONN_COLUMNS = [
    "timestamp", "uid", "src_ip", "src_port", "dst_ip", "dst_port", "protocol", "service", "duration",
    "orig_bytes", "resp_bytes", "conn_state", "local_orig", "local_resp", "missed_bytes", "history",
    "orig_pkts", "orig_ip_bytes", "resp_pkts", "resp_ip_bytes",
]

FLOW_SCHEMA = _struct(
    ("ts", T.TimestampType()), ("uid", S), ("src_ip", S), ("src_port", I), ("dst_ip", S), ("dst_port", I),
    ("protocol", S), ("service", S), ("duration", D), ("orig_bytes", L), ("resp_bytes", L), ("conn_state", S),
    ("local_orig", B), ("local_resp", B), ("missed_bytes", L), ("history", S), ("orig_pkts", L),
    ("orig_ip_bytes", L), ("resp_pkts", L), ("resp_ip_bytes", L),
)

# The columns whose text enters a flow's entropy.
TEXT_COLUMNS = ["uid", "src_ip", "dst_ip", "protocol", "service", "conn_state", "history"]

EVE_SCHEMA = _struct(
    ("timestamp", S), ("event_type", S), ("src_ip", S), ("src_port", I), ("dest_ip", S), ("dest_port", I),
    ("proto", S), ("flow_id", L),
    ("flow", _struct(("pkts_toserver", L), ("pkts_toclient", L), ("bytes_toserver", L), ("bytes_toclient", L))),
)

PACKET_SCHEMA = _struct(
    ("ts", T.TimestampType()), ("src_ip", S), ("dst_ip", S), ("src_port", I), ("dst_port", I),
    ("protocol", S), ("packet_size", L), ("flags", T.MapType(S, B)),
)

HTTP_SCHEMA = _struct(
    ("request_count", L), ("response_count", L), ("status_codes", COUNTS), ("avg_uri_length", D),
    ("unique_user_agents", L), ("methods", COUNTS),
)
DNS_SCHEMA = _struct(
    ("query_count", L), ("response_count", L), ("nxdomain_ratio", D), ("query_types", COUNTS),
    ("avg_domain_length", D), ("unique_domains", L),
)

FEATURE_SCHEMA = _struct(
    ("timestamp", T.TimestampType()), ("src_ip", S), ("dst_ip", S), ("src_port", I), ("dst_port", I),
    ("protocol", S), ("duration", D), ("packet_count", L), ("byte_count", L), ("packets_per_second", D),
    ("bytes_per_second", D), ("avg_packet_size", D), ("std_packet_size", D), ("min_packet_size", D),
    ("max_packet_size", D), ("tcp_flags", COUNTS), ("http_features", HTTP_SCHEMA), ("dns_features", DNS_SCHEMA),
    ("time_of_day", D), ("day_of_week", I), ("entropy", D), ("unique_dst_ports", L), ("unique_dst_ips", L),
    ("recent_flows", L), ("recent_bytes", L), ("recent_packets", L),
)

ANOMALY_RESULT = _struct(("anomaly_score", D), ("is_anomaly", B), ("model_name", S), ("threshold", D))
CLASS_RESULT = _struct(("prediction", S), ("confidence", D), ("is_attack", B), ("model_name", S), ("threshold", D))
SEQUENCE_RESULT = _struct(
    ("sequence_anomaly_score", D), ("is_sequence_anomaly", B), ("model_name", S), ("threshold", D)
)

RESULT_SCHEMA = _struct(
    ("timestamp", T.TimestampType()), ("src_ip", S), ("dst_ip", S), ("prediction", S), ("severity", S),
    ("risk_score", D), ("anomaly_score", D), ("sequence_anomaly_score", D), ("classification_confidence", D),
    ("is_anomaly", B), ("is_attack", B),
    ("model_results", _struct(("anomaly", ANOMALY_RESULT), ("classification", CLASS_RESULT),
                              ("sequence", SEQUENCE_RESULT))),
)

METRIC_SCHEMA = _struct(
    ("timestamp", T.TimestampType()), ("type", S), ("source", S), ("protocol", S), ("feature_type", S),
    ("model_name", S), ("prediction", S), ("severity", S), ("attack_type", S), ("policy_name", S), ("reason", S),
    ("component", S), ("error_type", S), ("operation", S), ("latency", D), ("name", S), ("value", D),
    ("labels", T.MapType(S, S)),
)
