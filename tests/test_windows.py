import random

import pytest
from helpers import brute_windows, records
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewarden.operators import anchored
from tidewarden.operators.anchored import anchored_starts, anchored_windows
from tidewarden.operators.flows import flow_windows, window_statistics
from tidewarden.operators.running import running_totals, sliced_totals, totals_between


def rows(seed, keys=4, count=400, span=300):
    pick = random.Random(seed)
    # One key holds more than a third of the rows; times repeat.
    return [("hot" if pick.random() < 0.4 else f"k{pick.randrange(keys)}", pick.randrange(span), i) for i in range(count)]


def test_busy_keys_meet_their_windows_in_bounded_tasks(spark, monkeypatch):
    monkeypatch.setattr(anchored, "TASK_ROWS", 50)
    df = spark.createDataFrame(rows(3), "key string, at long, id long")
    got = anchored_windows(df, ["key"], "at", "id", 10, None, 10, 1000)
    assert "REPARTITION_BY_NUM" in got._jdf.queryExecution().executedPlan().toString()
    assert {r["id"]: (r["window_at"], r["window_id"]) for r in got.collect()} == brute_windows(rows(3), 10, None)


@pytest.mark.parametrize("width,cap", [(10, None), (10, 3), (0, None), (50, 7), (1000, None), (1000, 5)])
@pytest.mark.parametrize("hot_rows,block_rows", [(10, 1000), (10, 40), (10, 9), (10_000, 1000)])
def test_windows_match_brute_force(spark, width, cap, hot_rows, block_rows):
    """Keys as arrays, as one block, as chained blocks, and with windows larger than a block."""
    data = rows(width + (cap or 0))
    df = spark.createDataFrame(data, "key string, at long, id long")
    want = brute_windows(data, width, cap)
    got = anchored_windows(df, ["key"], "at", "id", width, cap, hot_rows, block_rows).collect()
    assert len(got) == len(data)
    assert {r["id"]: (r["window_at"], r["window_id"]) for r in got} == want
    starts = anchored_starts(df, ["key"], "at", "id", width, cap, hot_rows, block_rows)
    assert starts.columns == df.columns and sorted(r["id"] for r in starts.collect()) == sorted({i for _, i in want.values()})


def test_blocks_are_chained_over_groups(spark, monkeypatch):
    """More blocks than a group holds, at a constant pace, so that no two chains ever meet."""
    monkeypatch.setattr("tidewarden.operators.chained.GROUP_BLOCKS", 3)
    data = [("k", i // 2, i) for i in range(500)] + [("l", i * i, 1000 + i) for i in range(120)]
    df = spark.createDataFrame(data, "key string, at long, id long").repartition(4)
    got = anchored_windows(df, ["key"], "at", "id", 3, 7, hot_rows=20, block_rows=16).collect()
    assert {r["id"]: (r["window_at"], r["window_id"]) for r in got} == brute_windows(data, 3, 7)


def test_mixed_hot_and_cold_keys(spark):
    data = rows(7, keys=30, count=600)
    df = spark.createDataFrame(data, "key string, at long, id long")
    got = anchored_windows(df, ["key"], "at", "id", 12, 4, hot_rows=50).collect()
    assert {r["id"]: (r["window_at"], r["window_id"]) for r in got} == brute_windows(data, 12, 4)


def test_boundaries(spark):
    """A record exactly at the width stays; one later opens; the record after a full window opens."""
    df = records(spark, [{"at": 0.0}, {"at": 60.0}, {"at": 60.000001}, {"at": 61.0}])
    got = {r["record_id"]: r["window_id"] for r in flow_windows(df).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 2}
    many = records(spark, [{"at": i / 100} for i in range(1001)])
    sizes = flow_windows(many).groupBy("window_id").count().collect()
    assert sorted(r["count"] for r in sizes) == [1, 1000]


def test_statistics_by_hand(spark):
    df = records(spark, [
        {"at": 0.0, "orig_bytes": 100, "orig_pkts": 2, "resp_bytes": 30, "resp_pkts": 3, "history": "ShA"},
        {"at": 10.0, "orig_bytes": 20, "orig_pkts": 0, "resp_bytes": 70, "resp_pkts": 1, "history": "-", "protocol": "udp"},
        {"at": 500.0, "orig_pkts": 0, "history": None},
    ])
    first, lone = window_statistics(flow_windows(df)).orderBy("window_at").collect()
    assert (first["byte_count"], first["packet_count"], first["duration"], first["protocol"]) == (220, 6, 10.0, "tcp")
    assert first["bytes_per_second"] == 22.0
    assert first["avg_packet_size"] == pytest.approx((50 + 10 + 70) / 3)
    assert first["std_packet_size"] == pytest.approx(24.9443826)
    assert (first["min_packet_size"], first["max_packet_size"]) == (10.0, 70.0)
    assert (first["SYN"], first["ACK"], first["RST"]) == (1, 1, 0)
    assert (lone["duration"], lone["bytes_per_second"], lone["avg_packet_size"], lone["SYN"]) == (0.0, 0.0, 0.0, None)


def test_sums_over_windows_equal_sums_over_records(spark, folder):
    from tidewarden.catalog.flows import stats
    from tidewarden.catalog.tables import flows

    s = stats(spark, folder).agg(F.sum("byte_count"), F.sum("SYN"), F.sum("record_count")).first()
    f = flows(spark, folder).agg(F.sum(F.col("orig_bytes") + F.col("resp_bytes")), F.sum(F.length("history") - F.length(F.replace("history", F.lit("S"), F.lit("")))), F.count("*")).first()
    assert tuple(s) == tuple(f)


def test_running_totals_across_slices(spark):
    pick = random.Random(3)
    data = [(pick.choice("ab"), pick.randrange(100), i, pick.randrange(-5, 9)) for i in range(300)]
    df = spark.createDataFrame(data, "key string, at long, id long, v long")
    got = {r["id"]: r["total"] for r in running_totals(df, ["key"], ["at", "id"], {"total": F.col("v")}, 7).collect()}
    for key, at, row_id, _ in data:
        assert got[row_id] == sum(v for k, t, i, v in data if k == key and (t, i) <= (at, row_id))


def test_totals_between_matches_brute_force(spark):
    pick = random.Random(4)
    events = [(pick.choice("ab"), pick.randrange(100), pick.randrange(9)) for _ in range(300)]
    probes = [(pick.choice("abc"), i, *sorted((pick.randrange(100), pick.randrange(100)))) for i in range(100)]
    got = totals_between(
        spark.createDataFrame(events, "key string, at long, v long"), spark.createDataFrame(probes, "key string, id long, since long, until long"),
        ["key"], ["id"], {"n": F.lit(1), "v": F.col("v"), "ever": F.col("v")}, 13, since_start=("ever",)).collect()
    assert len(got) == len(probes)
    want = {i: (sum(1 for k, t, _ in events if k == key and lo < t <= hi), sum(v for k, t, v in events if k == key and lo < t <= hi),
                sum(v for k, t, v in events if k == key and t <= hi)) for key, i, lo, hi in probes}
    assert {r["id"]: (r["n"], r["v"], r["ever"]) for r in got} == want


def test_null_times_and_keys_are_windowed_alike_on_both_paths(spark):
    rows = [(k, t, i) for i, (k, t) in enumerate([("a", None), ("a", None), ("a", 5), ("a", 40), (None, 3), (None, None), ("b", None), ("b", 100)])]
    df = spark.createDataFrame(rows, "k string, at long, id long")
    cold, hot, chained = (sorted(anchored_windows(df, ["k"], "at", "id", 10, None, hot_rows=n, block_rows=m).collect(), key=lambda r: r["id"])
                          for n, m in ((1000, 1000), (1, 1000), (1, 3)))
    assert cold == hot == chained and len(cold) == len(rows) and [r["window_id"] for r in cold] == [0, 0, 0, 3, 5, 5, 6, 7]


def test_running_totals_keep_rows_without_a_key(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 1)], "k string, at long")
    got = running_totals(df, ["k"], ["at"], {"n": F.lit(1)}, 10).collect()
    assert sorted((str(r["k"]), r["at"], r["n"]) for r in got) == [("None", 1, 1), ("None", 2, 2), ("a", 1, 1)]


@pytest.mark.parametrize("moments", [50, 1])
def test_slices_are_bounded_by_volume(spark, moments):
    """90 % of the rows are of one key in one minute, or all in one moment of it."""
    rows = spark.range(40_000).select(
        F.when(F.col("id") % 10 > 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 7)).alias("key"),
        F.when(F.col("id") % 10 > 0, F.col("id") % moments).otherwise(F.col("id") * 100).alias("at"), "id")
    sliced, cells = sliced_totals(rows.withColumn("v", F.lit(1)), ["key"], ["at", "id"], ["v"], 3600, slice_rows=2000)
    sizes = sorted(r["count"] for r in sliced.groupBy("_key").count().collect())
    assert sizes[-1] <= 2000 and sum(sizes) == 40_000
    assert 18 <= cells.filter("_key.key = 'hot'").count() <= 80
    assert sorted(r["_n"] for r in cells.collect()) == sizes
    total = running_totals(rows, ["key"], ["at", "id"], {"n": F.lit(1), "s": F.col("id") % 5}, 3600, slice_rows=2000)
    plain = Window.partitionBy("key").orderBy("at", "id").rowsBetween(Window.unboundedPreceding, 0)
    wrong = total.withColumns({"n1": F.count("*").over(plain), "s1": F.sum(F.col("id") % 5).over(plain)}).filter("n <> n1 or s <> s1")
    assert wrong.count() == 0 and total.count() == 40_000
