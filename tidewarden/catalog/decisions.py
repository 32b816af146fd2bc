"""Scores, fusion, policies, actions and blocks."""

import numpy as np
from pyspark.sql import functions as F

from tidewarden.catalog.flows import features, r6, stats
from tidewarden.catalog.registry import query
from tidewarden.catalog.tables import CAP, HOUR, LISTS_SQL, RESULTS_SQL, SECOND, STATS_SQL, WIDTH, blacklist, flows, table, whitelist, with_sql
from tidewarden.functions.records import micros
from tidewarden.functions.vector import feature_vector
from tidewarden.operators import actions, scoring
from tidewarden.operators.flows import feature_record
from tidewarden.operators.hosts import DISTINCT, RECENT
from tidewarden.operators.policies import (
    DEFAULT_POLICIES, Policy, add_policies, by_priority, decide, ip_list, mark_lists, policy_table, read_policies,
    remove_policies, update_policies,
)
from tidewarden.operators.serving import sequence_scorer
from tidewarden.plans.detection import decisions_of_events
from tidewarden.session import materialize

# An extra rule whose "allow" ends an address's block, so that block intervals have resets.
TRUSTED = Policy("trusted_service", "Allow quiet traffic to the file server",
                 {"prediction": "normal", "risk_score": {"max": 0.0}, "dst_ip": ["192.168.0.3", "192.168.0.9"]}, ["allow"], 4)
BLOCK_SECONDS = 6 * 3600
AS_OF = 1_705_300_000 * SECOND


def features_of(windows):
    return feature_record(windows.withColumns({n: F.lit(0) for n in (*DISTINCT, *RECENT)}))


def window_features(spark, sf):
    """Window features without host context, which the traffic rule does not read."""
    return features_of(stats(spark, sf, text=True))


def results_of(windows):
    return scoring.score(features_of(windows)).withColumn("result_id", F.col("window_id"))


def results(spark, sf):
    return results_of(stats(spark, sf, text=True))


def decisions(spark, sf, policies=DEFAULT_POLICIES):
    return decide(results(spark, sf), policies, whitelist(spark, sf), blacklist(spark, sf))


def acts(spark, sf):
    return actions.explode_actions(decisions(spark, sf, [*DEFAULT_POLICIES, TRUSTED]), whitelist(spark, sf))


def blocks(spark, sf):
    return actions.block_intervals(acts(spark, sf), BLOCK_SECONDS)


# The policy rows in SQL.
POLICIES_SQL = LISTS_SQL + """,
policies(ordinal, name, description, action, priority) as (values
  (0, 'high_risk_attack', 'Block high-risk attacks immediately', 'block_ip,alert', 1),
  (1, 'suspicious_activity', 'Alert on suspicious activity', 'alert,monitor', 2),
  (2, 'anomaly_detection', 'Alert on anomalies', 'alert', 3),
  (3, 'whitelist_override', 'Allow whitelisted IPs', 'allow', 0),
  (4, 'blacklist_immediate', 'Immediately block blacklisted IPs', 'block_ip,alert', 0),
  (5, 'trusted_service', 'Allow quiet traffic to the file server', 'allow', 4)),
matched as (
  select r.*, p.* exclude (description), 'Policy ' || name || ': ' || description as reason from results r join policies p on
    case p.name when 'high_risk_attack' then prediction = 'attack' and severity = 'high' and risk_score >= 0.8
      when 'suspicious_activity' then prediction = 'suspicious' and severity = 'medium' and risk_score >= 0.6
      when 'anomaly_detection' then is_anomaly and anomaly_score >= 0.7
      when 'whitelist_override' then src_ip in (select ip from whitelist)
      when 'blacklist_immediate' then src_ip in (select ip from blacklist)
      else {trusted} and prediction = 'normal' and risk_score <= 0 and dst_ip in ('192.168.0.3', '192.168.0.9') end),
ordered as (select *, cast(row_number() over (partition by result_id order by priority, ordinal) - 1 as integer) as rank from matched),
cut as (select *, min(case when contains(action, 'allow') then rank end) over (partition by result_id) as stop from ordered),
decisions as materialized (
  select * exclude (stop, ordinal), contains(action, 'block_ip') as auto_block,
    cast(case when contains(action, 'block_ip') then 300 else 0 end as integer) as block_duration, priority > 1 as requires_approval
  from cut where stop is null or rank <= stop)"""
DECISIONS_SQL = RESULTS_SQL + "," + POLICIES_SQL.replace("{trusted}", "false")
TRUSTED_SQL = RESULTS_SQL + "," + POLICIES_SQL.replace("{trusted}", "true")
ACTIONS_SQL = """,
actions as materialized (
  select d.*, cast(u.step - 1 as integer) as step, u.act from decisions d,
    lateral (select unnest(string_split(d.action, ',')) as act, generate_subscripts(string_split(d.action, ','), 1) as step) u
  where d.src_ip not in (select ip from whitelist))"""
BLOCKS_SQL = TRUSTED_SQL + ACTIONS_SQL + f""",
acts as materialized (
  select src_ip as ip, ts_us, result_id, rank, step, act, reason, name as policy_name, severity,
    sum(case when act = 'allow' then 1 else 0 end) over (partition by src_ip order by ts_us, result_id, rank, step) as episode
  from actions where act in ('block_ip', 'allow')),
attempts as materialized (
  select *, row_number() over (partition by ip order by ts_us, result_id, rank, step) as rn from acts where act = 'block_ip'),
lifted as (select ip, episode - 1 as episode, ts_us as lifted_at from acts where act = 'allow'),
reach as materialized (
  select a.*, l.lifted_at, least(a.ts_us + {BLOCK_SECONDS * SECOND}, coalesce(l.lifted_at, 9e18)) as until_us
  from attempts a left join lifted l on l.ip = a.ip and l.episode = a.episode),
onward as materialized (
  select r.ip, r.rn, least(
    (select min(n.rn) from attempts n where n.ip = r.ip and n.rn > r.rn and n.ts_us >= r.ts_us + {BLOCK_SECONDS * SECOND}),
    (select min(n.rn) from attempts n where n.ip = r.ip and n.episode > r.episode)) as nrn from reach r),
chain as (
  select ip, rn, nrn from onward where rn = 1
  union all select n.ip, n.rn, n.nrn from chain o join onward n on n.ip = o.ip and n.rn = o.nrn),
blocks as materialized (
  select r.ip, reason, policy_name, severity, ts_us as blocked_at, ts_us + {BLOCK_SECONDS * SECOND} as expires_at,
    cast(until_us as bigint) as ended_at, result_id from reach r join chain o on o.ip = r.ip and o.rn = r.rn)"""


@query("m1_anomaly_score", with_sql(STATS_SQL, """,
d as (select window_id, 0.4 - byte_count / 50000.0 as decision from stats)
select window_id, round(least(greatest(0.5 - decision, 0), 1), 6) as anomaly_score, least(greatest(0.5 - decision, 0), 1) > 0.8 as is_anomaly from d"""))
def _(spark, sf):
    """Decision values of a forest stand-in, normalised and tested."""
    s = stats(spark, sf).withColumn("score", scoring.anomaly_from_decision(F.lit(0.4) - F.col("byte_count") / 50000.0))
    a = s.select("window_id", scoring.anomaly_result("score").alias("a"))
    return a.select("window_id", F.round("a.anomaly_score", 6).alias("anomaly_score"), "a.is_anomaly")


@query("m2_classification", with_sql(RESULTS_SQL, """
select result_id, case when resets then 'attack' else 'normal' end as prediction, round(confidence, 6) as confidence, is_attack from flags"""))
def _(spark, sf):
    s = scoring.traffic_rule(window_features(spark, sf)).select("window_id", scoring.classification_result("_label", "_confidence").alias("c"))
    return s.select(F.col("window_id").alias("result_id"), "c.prediction", F.round("c.confidence", 6).alias("confidence"), "c.is_attack")


SEQUENCE_SQL = with_sql(STATS_SQL, """,
seqs as (select window_id, byte_count, sum(byte_count) over w as total, count(*) over w as n from stats
  window w as (partition by src_ip order by window_at, window_id rows 4 preceding)),
scored as (select window_id, case when n > 1 and total > 0 then least(1.0, byte_count / cast(total as double)) else 0.0 end as s from seqs)
select window_id, round(s, 6) as sequence_anomaly_score, s > 0.6 as is_sequence_anomaly from scored""")


@query("m3_sequence_score", SEQUENCE_SQL)
def _(spark, sf):
    """The last five windows of each host, scored by a plain rule; models plug in the same way."""
    v = feature_vector(window_features(spark, sf))
    s = scoring.host_sequences(v, 5).withColumn("score", scoring.mean_shift())
    r = s.select("window_id", scoring.sequence_result("score").alias("s"))
    return r.select("window_id", F.round("s.sequence_anomaly_score", 6).alias("sequence_anomaly_score"), "s.is_sequence_anomaly")


@query("m3_sliding_score", SEQUENCE_SQL)
def _(spark, sf):
    """The same rule as a function on arrays that slide over a host's blocks."""
    def rule(block):
        volume = block[:, :, 2].astype(float)
        held, total = (np.abs(block).sum(axis=2) > 0).sum(axis=1), volume.sum(axis=1)
        return np.where((held > 1) & (total > 0), np.minimum(1.0, volume[:, -1] / np.maximum(total, 1e-300)), 0.0)

    v = feature_vector(window_features(spark, sf)).select("window_id", "window_at", "src_ip", "vector")
    r = sequence_scorer(rule, 5, block=7)(v).select("window_id", scoring.sequence_result("_sequence").alias("s"))
    return r.select("window_id", F.round("s.sequence_anomaly_score", 6).alias("sequence_anomaly_score"), "s.is_sequence_anomaly")


@query("m3_sequence_default", with_sql(STATS_SQL, "select window_id, 0.0 as sequence_anomaly_score, false as is_sequence_anomaly from stats"))
def _(spark, sf):
    return stats(spark, sf).select("window_id", scoring.sequence_result(None).alias("s")).select(
        "window_id", "s.sequence_anomaly_score", "s.is_sequence_anomaly")


@query("m4_score_fusion", with_sql(RESULTS_SQL, """
select result_id, ts_us, src_ip, dst_ip, prediction, severity, round(risk_score, 6) as risk_score, round(anomaly_score, 6) as anomaly_score,
  0.0 as sequence_anomaly_score, round(classification_confidence, 6) as classification_confidence, is_anomaly, is_attack from results"""))
def _(spark, sf):
    return results(spark, sf).select("result_id", micros("timestamp").alias("ts_us"), "src_ip", "dst_ip", "prediction", "severity", r6("risk_score"),
        r6("anomaly_score"), "sequence_anomaly_score", r6("classification_confidence"), "is_anomaly", "is_attack")


@query("m5_processing_delay", with_sql(RESULTS_SQL, "select result_id, round((1706745600000000 - ts_us) / 1e6, 3) as processing_time from results"))
def _(spark, sf):
    """Seconds from each window's first record to a given moment."""
    delay = scoring.processing_delay(now=F.timestamp_seconds(F.lit(1706745600)))
    return results(spark, sf).select("result_id", F.round(delay, 3).alias("processing_time"))


@query("m6_result_counts", with_sql(RESULTS_SQL, """
select count(*) as inferences_processed, cast(count_if(anomaly_score > 0.8) as bigint) as anomalies_detected, cast(count_if(prediction = 'attack') as bigint) as attacks_classified from results"""))
def _(spark, sf):
    return scoring.result_counts(results(spark, sf))


@query("l6_best_class", """
select vec_id, cast(list_position(embedding, list_max(embedding)) - 1 as integer) as best, round(cast(list_max(embedding) as double), 6) as confidence from embeddings""")
def _(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", scoring.best_class("embedding").alias("best"),
        F.round(F.array_max("embedding").cast("double"), 6).alias("confidence"))


DECISION_COLUMNS = ["result_id", "rank", "src_ip", "dst_ip", "policy_name", "action", "reason", "severity", "auto_block", "block_duration", "requires_approval"]
DECISION_SELECT = """
select result_id, rank, ts_us, src_ip, dst_ip, name as policy_name, action, reason, severity, round(risk_score, 6) as risk_score, auto_block, block_duration,
  requires_approval from decisions"""


@query("j2_result_policies", with_sql(DECISIONS_SQL, DECISION_SELECT))
def _(spark, sf):
    return decisions(spark, sf).select(*DECISION_COLUMNS, micros("timestamp").alias("ts_us"), r6("risk_score"))


@query("w4_stop_after_allow", with_sql(TRUSTED_SQL, DECISION_SELECT))
def _(spark, sf):
    return decisions(spark, sf, [*DEFAULT_POLICIES, TRUSTED]).select(*DECISION_COLUMNS, micros("timestamp").alias("ts_us"), r6("risk_score"))


@query("p9_enabled_policies", with_sql(DECISIONS_SQL, """
select result_id, name as policy_name from decisions where name not in ('whitelist_override', 'anomaly_detection') and not exists
  (select 1 from whitelist w where w.ip = decisions.src_ip)
union all
select r.result_id, p.name from matched r join policies p using (name) where r.src_ip in (select ip from whitelist) and p.name not in ('whitelist_override', 'anomaly_detection')"""))
def _(spark, sf):
    off = [Policy(p.name, p.description, p.conditions, p.actions, p.priority, p.name not in ("whitelist_override", "anomaly_detection")) for p in DEFAULT_POLICIES]
    return decisions(spark, sf, off).select("result_id", "policy_name")


CONDITION_CASES = {
    "equal_text": {"prediction": "attack"}, "equal_flag": {"is_anomaly": True}, "listed": {"severity": ["high", "medium"]},
    "at_least": {"risk_score": {"min": 0.75}}, "between": {"risk_score": {"min": 0.5, "max": 0.9}}, "missing": {"no_such_field": 1},
    "unknown_operator": {"risk_score": {"over": 0.1}}, "unlike_types": {"prediction": {"min": 1}}, "both": {"is_attack": True, "severity": "high"},
}
# Cases that can't hold for any result; they give a row only if one holds all the same.
NEVER = ("missing", "unknown_operator", "unlike_types")


def with_zeros(made, expected, count):
    """Every expected row, with a count of 0 where ``made`` lacks it, and all other rows of ``made``."""
    return made.join(expected, expected.columns, "full").withColumn(count, F.coalesce(count, F.lit(0).cast("long")))


@query("p10_conditions", with_sql(RESULTS_SQL, """
select 'equal_text' as policy_name, count(*) as matches from results where prediction = 'attack'
union all select 'equal_flag', count(*) from results where is_anomaly
union all select 'listed', count(*) from results where severity in ('high', 'medium')
union all select 'at_least', count(*) from results where risk_score >= 0.75
union all select 'between', count(*) from results where risk_score between 0.5 and 0.9
union all select 'both', count(*) from results where is_attack and severity = 'high'"""))
def _(spark, sf):
    cases = [Policy(name, name, c, ["alert"], 1) for name, c in CONDITION_CASES.items()]
    made = decide(results(spark, sf), cases).groupBy("policy_name").agg(F.count(F.lit(1)).alias("matches"))
    return with_zeros(made, spark.createDataFrame([(name,) for name in CONDITION_CASES if name not in NEVER], "policy_name string"), "matches")


@query("p11_list_conditions", with_sql(DECISIONS_SQL, """
select name as policy_name, count(*) as matches, 'membership' as mode from decisions where priority = 0 group by 1"""))
def _(spark, sf):
    """Membership as intended; in the placeholder mode neither rule can match, so it adds no row."""
    lists = [p for p in DEFAULT_POLICIES if p.priority == 0]
    count = lambda d, mode: d.groupBy("policy_name").agg(F.count(F.lit(1)).alias("matches")).withColumn("mode", F.lit(mode))
    exact = decide(results(spark, sf), lists, whitelist(spark, sf), blacklist(spark, sf), placeholder=True)
    return count(decisions(spark, sf, lists), "membership").unionByName(count(exact, "placeholder"))


@query("p12_decision_rows", with_sql(DECISIONS_SQL, """
select name as policy_name, action, reason, severity, auto_block, block_duration, requires_approval, count(*) as decisions
from decisions group by all"""))
def _(spark, sf):
    d = decisions(spark, sf)
    return d.groupBy("policy_name", "action", "reason", "severity", "auto_block", "block_duration", "requires_approval").agg(
        F.count(F.lit(1)).alias("decisions"))


@query("p13_alerts", with_sql(DECISIONS_SQL + ACTIONS_SQL, """
select result_id, ts_us, src_ip, dst_ip, name as policy_name, action, severity, round(risk_score, 6) as risk_score, reason from actions where act = 'alert'"""))
def _(spark, sf):
    a = actions.alerts(actions.explode_actions(decisions(spark, sf), whitelist(spark, sf)))
    return a.select("result_id", micros("timestamp").alias("ts_us"), "src_ip", "dst_ip", "policy_name", "action", "severity", r6("risk_score"), "reason")


@query("p19_whitelist_skip", with_sql(DECISIONS_SQL, """
select result_id, rank, src_ip, src_ip not in (select ip from whitelist) as acts from decisions"""))
def _(spark, sf):
    d = decisions(spark, sf).select("result_id", "rank", "src_ip")
    acting = actions.skip_whitelisted(d, whitelist(spark, sf)).select("result_id", "rank", F.lit(True).alias("acts"))
    return d.join(acting, ["result_id", "rank"], "left").select("result_id", "rank", "src_ip", F.coalesce("acts", F.lit(False)).alias("acts"))


@query("p20_action_explode", with_sql(DECISIONS_SQL + ACTIONS_SQL, "select result_id, rank, step, act from actions"))
def _(spark, sf):
    return actions.explode_actions(decisions(spark, sf), whitelist(spark, sf)).select("result_id", "rank", "step", "act")


@query("p21_watch_list", with_sql(DECISIONS_SQL + ACTIONS_SQL, """
select src_ip, min(ts_us) as first_seen, max(ts_us) as last_seen, count(*) as times from actions where act = 'monitor' group by 1"""))
def _(spark, sf):
    w = actions.watch_list(actions.explode_actions(decisions(spark, sf), whitelist(spark, sf)))
    return w.select("src_ip", micros("first_seen").alias("first_seen"), micros("last_seen").alias("last_seen"), "times")


@query("j3_whitelist_anti", with_sql(DECISIONS_SQL, "select src_ip, count(*) as decisions from decisions where src_ip not in (select ip from whitelist) group by 1"))
def _(spark, sf):
    return actions.skip_whitelisted(decisions(spark, sf), whitelist(spark, sf)).groupBy("src_ip").agg(F.count(F.lit(1)).alias("decisions"))


@query("j4_list_membership", with_sql(RESULTS_SQL + "," + LISTS_SQL, """
select result_id, src_ip in (select ip from whitelist) as in_whitelist, src_ip in (select ip from blacklist) as in_blacklist from results"""))
def _(spark, sf):
    return mark_lists(results(spark, sf), whitelist(spark, sf), blacklist(spark, sf)).select(
        "result_id", F.col("_in_whitelist").alias("in_whitelist"), F.col("_in_blacklist").alias("in_blacklist"))


@query("j5_value_in_list", with_sql(RESULTS_SQL, "select result_id, dst_ip from results where dst_ip in ('192.168.0.1', '192.168.0.3')"))
def _(spark, sf):
    listed = Policy("listed", "", {"dst_ip": ["192.168.0.1", "192.168.0.3"]}, ["alert"])
    return decide(results(spark, sf), [listed]).select("result_id", "dst_ip")


@query("j7_new_blocks", with_sql(BLOCKS_SQL, """
select (select count(*) from attempts) as attempts, count(*) as opened, (select count(*) from attempts) - count(*) as already_blocked from blocks"""))
def _(spark, sf):
    done = materialize(acts(spark, sf))  # read for the attempts and for the blocks
    a = done.filter("act = 'block_ip'").select(F.lit(1).alias("attempt"), F.lit(0).alias("block"))
    b = actions.block_intervals(done, BLOCK_SECONDS).select(F.lit(0).alias("attempt"), F.lit(1).alias("block"))
    return a.unionByName(b).agg(F.sum("attempt").alias("attempts"), F.sum("block").alias("opened")).withColumn(
        "already_blocked", F.col("attempts") - F.col("opened"))


@query("w5_block_intervals", with_sql(BLOCKS_SQL, "select * from blocks"))
def _(spark, sf):
    return blocks(spark, sf).drop("auto_unblock")


@query("w5_block_intervals_hot", with_sql(BLOCKS_SQL, "select ip, blocked_at, ended_at, result_id from blocks"))
def _(spark, sf):
    """Every episode above five attempts goes the way of hot keys, in blocks of ten attempts."""
    return actions.block_intervals(acts(spark, sf), BLOCK_SECONDS, hot_rows=5, block_rows=10).select("ip", "blocked_at", "ended_at", "result_id")


@query("j8_active_blocks", with_sql(BLOCKS_SQL, f"select ip, blocked_at, expires_at, policy_name from blocks where blocked_at <= {AS_OF} and ended_at > {AS_OF}"))
def _(spark, sf):
    return actions.active_blocks(blocks(spark, sf), AS_OF).select("ip", "blocked_at", "expires_at", "policy_name")


@query("j8_blocked_at_time", with_sql(BLOCKS_SQL, """
select f.record_id, f.src_ip as ip, exists (select 1 from blocks b where b.ip = f.src_ip and b.blocked_at <= f.ts_us and b.ended_at > f.ts_us) as is_blocked from flows f"""))
def _(spark, sf):
    """Every flow record against the block intervals of its source."""
    rows = flows(spark, sf).select("record_id", F.col("src_ip").alias("ip"), micros().alias("until"))
    return actions.blocked_at_time(rows, blocks(spark, sf), ["record_id"])


@query("a19_decision_counts", with_sql(DECISIONS_SQL, """
select count(*) as decisions, cast(count_if(contains(action, 'block_ip')) as bigint) as blocks_executed, cast(count_if(contains(action, 'alert')) as bigint) as alerts_sent from decisions"""))
def _(spark, sf):
    return actions.decision_counts(decisions(spark, sf))


@query("u3_key_removal", with_sql(BLOCKS_SQL, f"""
select ip, result_id from blocks where ip not in (select ip from blocks where blocked_at <= {AS_OF} and ended_at > {AS_OF})"""))
def _(spark, sf):
    b = materialize(blocks(spark, sf))
    return actions.remove_keys(b, actions.active_blocks(b, AS_OF), "ip").select("ip", "result_id")


@query("u4_list_to_set", """
select '10.0.' || (n_nationkey % 5) || '.1' as ip from nation group by 1""")
def _(spark, sf):
    n = table(spark, sf, "nation").select(F.concat(F.lit("10.0."), (F.col("n_nationkey") % 5).cast("string"), F.lit(".1")).alias("ip"))
    return ip_list(n)


@query("s11_ip_lists", f"with {LISTS_SQL} select ip, 'whitelist' as kind from whitelist union all select ip, 'blacklist' from blacklist")
def _(spark, sf):
    return ip_list(whitelist(spark, sf)).withColumn("kind", F.lit("whitelist")).unionByName(
        ip_list(blacklist(spark, sf)).withColumn("kind", F.lit("blacklist")))


@query("l3_policy_order", with_sql(DECISIONS_SQL, """
select name as policy_name, cast(row_number() over (order by priority, ordinal) - 1 as integer) as place, (select count(*) from decisions d where d.name = policies.name) as decisions
from policies where name <> 'trusted_service'"""))
def _(spark, sf):
    """Policies in order of evaluation, with how often each decided."""
    places = spark.createDataFrame([(p.name, i) for i, p in enumerate(by_priority(DEFAULT_POLICIES))], "policy_name string, place int")
    made = decisions(spark, sf).groupBy("policy_name").agg(F.count(F.lit(1)).alias("decisions"))
    return places.join(made, "policy_name", "left").select("policy_name", "place", F.coalesce("decisions", F.lit(0)).alias("decisions"))


@query("e2_policy_edits", with_sql(RESULTS_SQL, """
select 'anomaly_detection' as policy_name, 'block_ip' as action, false as requires_approval, count(*) as decisions from results where is_anomaly and anomaly_score >= 0.7
union all select 'quiet_host', 'monitor', true, count(*) from results where prediction = 'normal'
union all select 'suspicious_activity', 'alert,monitor', false, count(*) from results where prediction = 'suspicious' and severity = 'medium' and risk_score >= 0.6"""))
def _(spark, sf):
    """Add, replace, remove and update policies, then decide with the edited table; a policy that decides nothing has a row too."""
    t = policy_table(spark)
    fresh = policy_table(spark, [
        Policy("quiet_host", "Watch quiet hosts", {"prediction": "normal"}, ["monitor"], 5),
        Policy("anomaly_detection", "Block anomalies", {"is_anomaly": True, "anomaly_score": {"min": 0.7}}, ["block_ip"], 1),
    ])
    t = add_policies(t, fresh)
    t = remove_policies(t, spark.createDataFrame([("high_risk_attack",), ("whitelist_override",), ("blacklist_immediate",), ("absent",)], "name string"))
    t = update_policies(t, spark.createDataFrame([("suspicious_activity", 1, "ignored")], "name string, priority int, colour string"))
    made = decide(results(spark, sf), read_policies(t)).groupBy("policy_name", "action", "requires_approval").agg(F.count(F.lit(1)).alias("decisions"))
    edited = t.select(F.col("name").alias("policy_name"), F.array_join("actions", ",").alias("action"), (F.col("priority") > 1).alias("requires_approval"))
    return with_zeros(made, edited, "decisions")


@query("e3_default_policies", with_sql(DECISIONS_SQL, """
select name, description, action, cast(priority as integer) as priority, (select count(*) from decisions d where d.name = policies.name) as decisions
from policies where name <> 'trusted_service'"""))
def _(spark, sf):
    t = policy_table(spark).select("name", "description", F.array_join("actions", ",").alias("action"), "priority")
    made = decisions(spark, sf).groupBy(F.col("policy_name").alias("name")).agg(F.count(F.lit(1)).alias("decisions"))
    return t.join(made, "name", "left").withColumn("decisions", F.coalesce("decisions", F.lit(0)))


@query("k10_audit_log", with_sql(BLOCKS_SQL, f"""
select 'attack_detected' as event_type, ts_us, name as attack_type, src_ip as source_ip, dst_ip as target_ip, round(risk_score, 6) as confidence,
  cast(null as varchar) as ip, cast(null as varchar) as reason, cast(null as integer) as duration, action || '/' || severity as details
from decisions where src_ip not in (select ip from whitelist)
union all select 'block_action', blocked_at, null, null, null, null, ip, reason, {BLOCK_SECONDS}, null from blocks"""))
def _(spark, sf):
    d = actions.skip_whitelisted(decisions(spark, sf, [*DEFAULT_POLICIES, TRUSTED]), whitelist(spark, sf))
    log = actions.audit_log(actions.attack_audit(d), actions.block_audit(blocks(spark, sf), BLOCK_SECONDS))
    return log.select("event_type", micros("timestamp").alias("ts_us"), "attack_type", "source_ip", "target_ip", r6("confidence"), "ip", "reason",
                      "duration", F.concat("details.action", F.lit("/"), "details.severity").alias("details"))


@query("k10_audit_reports", f"""
select 'false_positive' as event_type, epoch_us(ts) as ts_us, cast(event_id as varchar) as alert_id, 'analyst' || (user_id % 3) as analyst,
  cast(props as varchar) as reason, cast(null as varchar) as model_name, cast(null as varchar) as version, cast(null as double) as accuracy from events where event_type = 'error'
union all select 'model_update', epoch_us(ts), null, null, null, 'model' || (user_id % 2), cast(event_id % 50 as varchar), round(value / 1000, 6)
from events where event_type = 'signup'""")
def _(spark, sf):
    """The audit events that people and training runs cause: false positives and model updates."""
    e = table(spark, sf, "events").withColumn("timestamp", F.col("ts").cast("timestamp"))
    label = lambda p, n: F.concat(F.lit(p), (F.col("user_id") % n).cast("string"))
    reports = e.filter("event_type = 'error'").select(
        "timestamp", F.col("event_id").cast("string").alias("alert_id"), label("analyst", 3).alias("analyst"), F.col("props").alias("reason"))
    updates = e.filter("event_type = 'signup'").select(
        "timestamp", label("model", 2).alias("model_name"), (F.col("event_id") % 50).cast("string").alias("version"),
        F.create_map(F.lit("accuracy"), F.col("value") / 1000).alias("performance"))
    log = actions.audit_log(actions.false_positive_audit(reports), actions.model_update_audit(updates))
    return log.select("event_type", micros("timestamp").alias("ts_us"), "alert_id", "analyst", "reason", "model_name", "version",
                      F.round(F.try_element_at("performance", F.lit("accuracy")), 6).alias("accuracy"))


@query("flagship_decisions", with_sql(RESULTS_SQL, """
select result_id, src_ip, 'high_risk_attack' as policy_name, severity, round(risk_score, 6) as risk_score from results where prediction = 'attack' and severity = 'high' and risk_score >= 0.8
union all select result_id, src_ip, 'suspicious_activity', severity, round(risk_score, 6) from results where prediction = 'suspicious' and severity = 'medium' and risk_score >= 0.6
union all select result_id, src_ip, 'anomaly_detection', severity, round(risk_score, 6) from results where is_anomaly and anomaly_score >= 0.7"""))
def _(spark, sf):
    return decisions_of_events(spark, sf).select("result_id", "src_ip", "policy_name", "severity", r6("risk_score"))
