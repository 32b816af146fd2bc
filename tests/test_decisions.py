import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidewarden.functions.vector import ENTRY_NAMES, feature_vector
from tidewarden.operators import scoring
from tidewarden.operators.actions import active_blocks, block_intervals, blocked_at_time, explode_actions
from tidewarden.operators.policies import (
    DEFAULT_POLICIES, Policy, add_policies, by_priority, decide, policy_table, read_policies, remove_policies, update_policies,
)

RESULT = "result_id long, timestamp timestamp, src_ip string, dst_ip string, prediction string, severity string, risk_score double, anomaly_score double, is_anomaly boolean"
NOW = dt.datetime(2024, 1, 1)


def results(spark, *rows):
    base = {"src_ip": "192.168.1.1", "dst_ip": "192.168.1.2", "prediction": "normal", "severity": "low", "risk_score": 0.0, "anomaly_score": 0.0, "is_anomaly": False}
    return spark.createDataFrame([(i, NOW, *{**base, **r}.values()) for i, r in enumerate(rows)], RESULT)


def names(df):
    return [r["policy_name"] for r in df.orderBy("result_id", "rank").collect()]


def test_attack_gives_one_decision(spark):
    d = decide(results(spark, {"prediction": "attack", "severity": "high", "risk_score": 0.9})).collect()
    assert len(d) == 1
    assert (d[0]["policy_name"], d[0]["action"], d[0]["block_duration"], d[0]["requires_approval"]) == ("high_risk_attack", "block_ip,alert", 300, False)


def test_minimum_is_inclusive_and_missing_never_matches(spark):
    r = results(spark, {"prediction": "attack", "severity": "high", "risk_score": 0.8}, {"prediction": "attack", "severity": "high", "risk_score": 0.79})
    assert names(decide(r)) == ["high_risk_attack"]
    assert names(decide(r, [Policy("p", "", {"absent": 1}, ["alert"])])) == []
    assert names(decide(r.withColumn("risk_score", F.lit(None).cast("double")))) == []


def test_unlike_types_and_unknown_operators_never_match(spark):
    r = results(spark, {"is_anomaly": True})
    for c in ({"prediction": 1}, {"risk_score": "0.0"}, {"prediction": {"min": 1}}, {"risk_score": {"near": 0}}):
        assert names(decide(r, [Policy("p", "", c, ["alert"])])) == []
    assert names(decide(r, [Policy("p", "", {"is_anomaly": 1}, ["alert"])])) == ["p"]


def test_allow_stops_and_equal_priorities_keep_order(spark):
    ps = [Policy("z", "", {"prediction": "normal"}, ["alert"], 1), Policy("a", "", {"prediction": "normal"}, ["allow"], 1), Policy("m", "", {"prediction": "normal"}, ["block_ip"], 2)]
    assert names(decide(results(spark, {}), ps)) == ["z", "a"]
    assert names(decide(results(spark, {}), [])) == []


def test_list_conditions(spark):
    white = spark.createDataFrame([("192.168.1.1",), ("192.168.1.1",)], "ip string")
    r = results(spark, {"prediction": "attack", "severity": "high", "risk_score": 0.9})
    assert names(decide(r, DEFAULT_POLICIES, white)) == ["whitelist_override"]
    assert names(decide(r, DEFAULT_POLICIES, white, white, placeholder=True)) == ["high_risk_attack"]
    assert explode_actions(decide(r), white).count() == 0


def test_policy_edits(spark):
    t = add_policies(policy_table(spark), policy_table(spark, [Policy("new", "", {}, ["alert"], 1), Policy("high_risk_attack", "changed", {}, ["alert"], 9)]))
    t = remove_policies(t, spark.createDataFrame([("anomaly_detection",)], "name string"))
    t = update_policies(t, spark.createDataFrame([("new", False, "x")], "name string, enabled boolean, colour string"))
    ps = {p.name: p for p in read_policies(t)}
    assert list(ps) == ["high_risk_attack", "suspicious_activity", "whitelist_override", "blacklist_immediate", "new"]
    assert (ps["high_risk_attack"].description, ps["new"].enabled, ps["new"].updated_at is not None) == ("changed", False, True)
    assert [p.priority for p in by_priority(DEFAULT_POLICIES)] == [0, 0, 1, 2, 3]


@pytest.mark.parametrize("confidence,anomaly,want", [
    (0.8, 0.0, ("normal", "low", 0.8)), (0.81, 0.0, ("attack", "high", 0.81)), (0.7, 0.0, ("normal", "low", 0.0)),
    (0.0, 0.8, ("normal", "low", 0.0)), (0.0, 0.9, ("suspicious", "medium", 0.9)), (0.75, 0.9, ("attack", "high", 0.9)),
])
def test_fusion_boundaries(spark, confidence, anomaly, want):
    df = spark.createDataFrame([("a", "b", anomaly, confidence, "attack")], "src_ip string, dst_ip string, _anomaly double, _confidence double, _label string")
    r = scoring.score(df, lambda x: x).first()
    assert (r["prediction"], r["severity"], r["risk_score"]) == want


def test_sequence_alone_is_suspicious_but_not_published_as_anomaly_score(spark):
    df = spark.createDataFrame([("a", "b", 0.1, 0.65)], "src_ip string, dst_ip string, _anomaly double, _sequence double")
    r = scoring.score(df, lambda x: x).first()
    assert (r["prediction"], r["risk_score"], r["anomaly_score"], r["is_anomaly"]) == ("suspicious", 0.65, 0.1, True)


def test_vector_has_36_entries_and_missing_are_zero(spark):
    full = spark.createDataFrame([(10.5, 100, {"SYN": 1, "ACK": 1})], "duration double, packet_count long, tcp_flags map<string,long>")
    v = feature_vector(full).first()["vector"]
    assert len(v) == len(ENTRY_NAMES) == 36
    assert (v[0], v[1], v[17], v[18], sum(v)) == (10.5, 100.0, 1.0, 1.0, 112.5)
    bad = spark.createDataFrame([(10.5, {"SYN": "x"})], "duration double, tcp_flags map<string,string>")
    assert sum(feature_vector(bad).first()["vector"]) == 0.0


def acts(spark, rows):
    data = [(i, 0, 0, NOW + dt.timedelta(seconds=at), ip, act, "r", "p", "high") for i, (ip, at, act) in enumerate(rows)]
    return spark.createDataFrame(data, "result_id long, rank int, step int, timestamp timestamp, src_ip string, act string, reason string, policy_name string, severity string")


def brute_blocks(rows, seconds):
    out, active = [], {}
    for ip, at, i, act in sorted((ip, at, i, act) for i, (ip, at, act) in enumerate(rows)):
        block = active.get(ip)
        if block and at >= block[0] + seconds:
            block = active[ip] = None
        if act == "allow" and block:
            block[2] = at
            active[ip] = None
        elif act == "block_ip" and not block:
            active[ip] = [at, i, at + seconds]
            out.append((ip, active[ip]))
    return sorted((ip, b[0], b[2], b[1]) for ip, b in out)


def seconds_of(df):
    base = int(NOW.replace(tzinfo=dt.timezone.utc).timestamp() * 1e6)
    return sorted((r["ip"], (r["blocked_at"] - base) // 1_000_000, (r["ended_at"] - base) // 1_000_000, r["result_id"]) for r in df.collect())


@pytest.mark.parametrize("hot_rows", [5, 20_000])
def test_blocks_match_brute_force(spark, hot_rows):
    pick = random.Random(hot_rows)
    rows = [("hot" if pick.random() < 0.5 else pick.choice("abc"), pick.randrange(5000), "allow" if pick.random() < 0.05 else "block_ip") for _ in range(400)]
    assert seconds_of(block_intervals(acts(spark, rows), 300, hot_rows)) == brute_blocks(rows, 300)


def test_block_expires_exactly(spark):
    b = block_intervals(acts(spark, [("a", 0, "block_ip"), ("a", 299, "block_ip"), ("a", 300, "block_ip")]))
    assert [x[1:3] for x in seconds_of(b)] == [(0, 300), (300, 600)]
    base = int(NOW.replace(tzinfo=dt.timezone.utc).timestamp() * 1e6)
    assert active_blocks(b, base + 300_000_000).count() == 1
    asked = spark.createDataFrame([("a", i, base + s * 1_000_000) for i, s in enumerate((-1, 0, 599, 600))] + [("z", 9, base)], "ip string, id long, until long")
    assert {r["id"]: r["is_blocked"] for r in blocked_at_time(asked, b, ["id"]).collect()} == {0: False, 1: True, 2: True, 3: False, 9: False}


def test_sequences_reach_back_over_block_borders(spark):
    pick = random.Random(9)
    rows = [("hot" if pick.random() < 0.7 else "b", pick.randrange(50) * 86_400_000_000, i, [float(i)]) for i in range(60)]
    df = spark.createDataFrame(rows, "src_ip string, window_at long, window_id long, vector array<double>")
    got = {r["window_id"]: [v[0] for v in r["sequence"]] for r in scoring.host_sequences(df, 4, block=5).collect()}
    for host in ("hot", "b"):
        mine = [r[2] for r in sorted((r for r in rows if r[0] == host), key=lambda r: r[1:3])]
        for i, window in enumerate(mine):
            assert got[window] == [float(x) for x in mine[max(0, i - 3): i + 1]]
