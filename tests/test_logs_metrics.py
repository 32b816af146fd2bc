import datetime as dt

import pytest
from helpers import records
from pyspark.sql import functions as F

from tidewarden.functions.text import character_entropy, text_entropy
from tidewarden.operators import hosts, monitoring as m
from tidewarden.operators.flows import flow_features
from tidewarden.schemas import FLOW_SCHEMA
from tidewarden.sinks.keyed import keyed_json, write_keyed_json
from tidewarden.sources.conn_log import read_conn_log, read_conn_rejects
from tidewarden.sources.eve_log import decode_json, good_json, normalise_eve, read_eve_log
from tidewarden.sources.labelled import read_labelled_csv

LINE = "1704067200.5\tC1\t10.0.0.1\t1024\t10.0.0.2\t80\ttcp\thttp\t-\t100\t-\tSF\tT\tF\t0\tShADadFf\t5\t300\t4\t-"


def test_conn_log(spark, tmp_path):
    fields = LINE.split("\t")
    bad = "\t".join(["x", *fields[1:]])
    (tmp_path / "conn.log").write_text("\n".join(["#separator", LINE, "\t".join(fields[:19]), bad, LINE + "\textra"]) + "\n")
    rows = read_conn_log(spark, str(tmp_path)).collect()
    assert len(rows) == 2  # the row after the bad one survives
    r = rows[0]
    assert (r["duration"], r["orig_bytes"], r["resp_bytes"], r["local_orig"], r["local_resp"], r["resp_ip_bytes"]) == (0.0, 100, 0, True, False, 0)
    assert r["ts"] == dt.datetime(2024, 1, 1, 0, 0, 0, 500000)
    assert sorted(x["reject_reason"] for x in read_conn_rejects(spark, str(tmp_path)).collect()) == ["bad number", "short line"]


def test_eve_log(spark, tmp_path):
    (tmp_path / "eve.json").write_text(
        '{"timestamp": "2024-01-01T00:00:01.250000+0000", "event_type": "flow", "src_ip": "1.1.1.1", "dest_ip": "2.2.2.2", "dest_port": 53, "proto": "UDP", "flow": {"bytes_toserver": 70}}\n'
        "not json\n")
    r = normalise_eve(read_eve_log(spark, str(tmp_path))).collect()
    assert len(r) == 1
    assert (r[0]["dst_ip"], r[0]["dst_port"], r[0]["protocol"], r[0]["orig_bytes"], r[0]["src_port"]) == ("2.2.2.2", 53, "udp", 70, 0)
    assert r[0]["ts"] == dt.datetime(2024, 1, 1, 0, 0, 1, 250000)


def test_labelled_csv_needs_its_label(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,name,Label\n1,x,p\n,y,q\n")
    t = read_labelled_csv(spark, str(tmp_path))
    assert t.columns == ["Label", "a"] and sorted(r["a"] for r in t.collect()) == [0, 1]
    with pytest.raises(ValueError):
        read_labelled_csv(spark, str(tmp_path), label="Class")


def test_keyed_messages(spark, tmp_path):
    df = spark.createDataFrame([(None, 1), ("a", 2)], "src_ip string, n int")
    assert sorted(r["key"] for r in keyed_json(df, "src_ip").collect()) == ["a", "unknown"]
    write_keyed_json(df, "src_ip", str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_entropy(spark):
    df = spark.createDataFrame([(1, "aabb"), (2, ""), (3, "aaaa"), (4, "abcd"), (5, "\n€a€")], "id int, t string")
    want = {1: 1.0, 2: 0.0, 3: 0.0, 4: 2.0, 5: 1.5}
    assert {r["id"]: r["e"] for r in df.select("id", text_entropy(F.col("t")).alias("e")).collect()} == want
    assert {r["id"]: r["entropy"] for r in character_entropy(df, ["id"], ["t"]).collect()} == want


def test_entropy_reads_a_text_once(spark):
    """Whatever its alphabet; before, every different character was searched for in the whole text."""
    df = spark.createDataFrame([(1, "".join(chr(0x4E00 + i) for i in range(4096)) + "\U0001F600" * 4096), (2, None)], "id int, t string")
    got = df.select("id", text_entropy(F.col("t")).alias("e"))
    assert "replace(" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert {r["id"]: round(r["e"], 9) for r in got.collect()} == {1: 7.0, 2: 0.0}


def test_messages_are_decoded_once(spark, tmp_path):
    lines = ['{"src_ip": "a"}', "no json", "[]", "", '{"src_ip": "b"}']
    spark.createDataFrame([(x,) for x in lines], "value string").write.text(str(tmp_path / "in"))
    read = spark.read.text(str(tmp_path / "in"))
    decoded = good_json(decode_json(read, FLOW_SCHEMA))
    assert decoded._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1
    assert sorted(r["src_ip"] for r in decoded.collect()) == ["a", "b"]
    assert decode_json(read, FLOW_SCHEMA).filter("reject_reason is not null").count() == 3


def test_application_logs_are_read_once(spark, tmp_path):
    """The statistics of a log read it several times: they read it as written with its windows, not its files."""
    df = records(spark, [{"at": 0.0, "uid": "u0"}, {"at": 100.0, "uid": "u1"}])
    log = [("u0", "GET", "/a", 200, "x"), ("u0", "GET", "/b", 404, "y"), ("u9", "PUT", "/", 200, "x")]
    spark.createDataFrame(log, "uid string, method string, uri string, status int, user_agent string").write.parquet(str(tmp_path / "http"))
    found = flow_features(df, http=spark.read.parquet(str(tmp_path / "http")))
    assert not [f for f in found.inputFiles() if "/http/" in f]
    got = {r["window_id"]: r["http_features"] for r in found.collect()}
    assert got[0]["request_count"] == 2 and got[0]["status_codes"] == {"200": 1, "404": 1} and got[1]["request_count"] == 0


def test_host_context_skips_unknown(spark):
    df = records(spark, [{"at": 0.0, "dst_ip": "", "dst_port": 0}, {"at": 1.0}, {"at": 2.0, "dst_ip": "c"}, {"at": 3.0, "src_ip": ""}, {"at": 70.0, "dst_port": 81}])
    got = {r["record_id"]: (r["unique_dst_ips"], r["unique_dst_ports"]) for r in hosts.distinct_so_far(df).collect()}
    assert got == {0: (0, 0), 1: (1, 1), 2: (2, 1), 4: (2, 2)}
    recent = {r["record_id"]: r["recent_flows"] for r in hosts.trailing_totals(df, 60_000_000).collect()}
    assert recent == {0: 1, 1: 2, 2: 3, 4: 1}


def test_host_alert_limits(spark):
    rows = [(1, 80.0, 85.0, 90.0, [4.0]), (2, 80.1, 94.9, 95.0, [8.0]), (3, 90.0, 0.0, 0.0, [0.0])]
    df = spark.createDataFrame(rows, "id int, cpu_percent double, memory_percent double, disk_usage_percent double, load_average array<double>").withColumn("timestamp", F.current_timestamp())
    got = sorted((r["id"], r["type"], r["severity"]) for r in m.host_alerts(df).collect())
    assert got == [(2, "high_cpu", "warning"), (2, "high_disk", "critical"), (2, "high_load", "critical"), (2, "high_memory", "warning"), (3, "high_cpu", "critical")]


def test_histogram_is_monotone(spark, folder):
    from tidewarden.catalog.tables import metric_events

    for _, g in m.latency_histogram(metric_events(spark, folder)).toPandas().groupby(["component", "operation"]):
        g = g.assign(bound=g["le"].replace("+Inf", "inf").astype(float)).sort_values("bound")
        assert g["cumulative"].is_monotonic_increasing and g["cumulative"].iloc[-1] == g["observations"].iloc[0]
