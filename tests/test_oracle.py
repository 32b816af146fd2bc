"""A cross-section of the registered queries against their SQL, and the shape of the plans."""

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check_oracle import TABLES, normal

CHECKED = [
    "w1_flow_windows", "w1_flow_windows_hot_keys", "p5_feature_record", "a9_entropy", "a10_distinct_destinations", "w2_trailing_window",
    "a11_bounded_history", "m3_sequence_score", "m4_score_fusion", "w4_stop_after_allow", "p10_conditions", "w5_block_intervals", "j8_blocked_at_time",
    "a15_counters", "a16_latency_histogram", "s1_conn_log", "s2_eve_log", "k2_feature_messages", "r3_stratified_split", "a21_class_auc",
    "t1_stream_windows", "t5_late_rows", "flagship_decisions",
]


@pytest.fixture(scope="module")
def con(folder):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for name in TABLES.split():
        con.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, folder, con, name):
    got = entry.queries()[name](spark, folder).toPandas()
    want = con.sql(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert normal(got) == normal(want)


@pytest.mark.parametrize("name", ["e2_policy_edits", "p10_conditions"])
@pytest.mark.parametrize("value, k", [(1.0, 1), (1.0, 3), (90.0, 2)])
def test_policies_that_decide_nothing_have_a_row(spark, folder, tmp_path, name, value, k):
    """Quiet windows only, or anomalies only, so that some conditions hold for no window."""
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    con.execute(f"""copy (select * replace ({value}::double as value, '{{"k": {k}}}' as props) from '{folder}/events.parquet') to '{tmp_path}/events.parquet'""")
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet'")
    want = con.sql(entry.oracle_sql()[name]).df()
    assert normal(entry.queries()[name](spark, str(tmp_path)).toPandas()) == normal(want)


def test_all_stages_place_windows_once(spark, folder, con, monkeypatch):
    """Features, scoring and decisions read one table of windows."""
    from tidewarden.catalog import decisions, flows, metrics

    placed, original = [], flows.stats
    for module in (decisions, metrics):
        monkeypatch.setattr(module, "stats", lambda *args, **named: placed.append(1) or original(*args, **named))
    got = entry.queries()["a18_all_stages"](spark, folder).toPandas()
    assert len(placed) == 1
    assert normal(got) == normal(con.sql(entry.oracle_sql()["a18_all_stages"]).df())


def test_entry_has_a_stable_schema(spark):
    df = entry.entry(spark)
    assert df.columns[:3] == ["result_id", "rank", "timestamp"] and df.count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["p5_feature_record", "w4_stop_after_allow", "j8_blocked_at_time", "a16_latency_histogram", "w2_trailing_window"])
def test_plans_have_no_cross_joins(spark, folder, name):
    plan = entry.queries()[name](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_scans_read_only_what_they_need(spark, folder):
    plan = entry.queries()["a15_counters"](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<user_id:bigint,event_type:string,props:string>" in plan
