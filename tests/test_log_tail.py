"""Logs that grow, are replaced, or end in the middle of a line."""

import os
import random

import pytest
from pyspark.sql import functions as F

from tidewarden.session import run_dir
from tidewarden.sinks.keyed import stream_keyed_json
from tidewarden.sources.eve_log import normalise_eve
from tidewarden.sources.log_tail import LogTailReader, tail_lines
from tidewarden.streaming.runner import METRIC_TRIGGER, start


def read_all(reader, before, after):
    rows = []
    for piece in reader.partitions(before, after):
        for batch in reader.read(piece):
            rows += [(r["file"], r["at"], r["value"]) for r in batch.to_pylist()]
    return rows


@pytest.mark.parametrize("piece", [1, 7, 64, 10_000])
def test_no_line_is_lost_or_repeated(tmp_path, piece):
    pick = random.Random(piece)
    lines = {n: [("é" * pick.randrange(3) + "x" * pick.randrange(40)).encode() + b"\n" for _ in range(200)] for n in ("a.log", "b.log")}
    reader, offset, got = LogTailReader(str(tmp_path), "*.log", piece), {}, []
    (tmp_path / "other.txt").write_text("not a log\n")
    data = {n: b"".join(part) for n, part in lines.items()}
    cuts = {n: sorted(pick.randrange(len(d)) for _ in range(12)) + [len(d)] for n, d in data.items()}
    for k in range(13):
        for n, d in data.items():
            (tmp_path / n).write_bytes(d[: cuts[n][k]])
        reader = LogTailReader(str(tmp_path), "*.log", piece)  # as after a restart
        new = reader.latestOffset()
        got += read_all(reader, offset, new)
        offset = new
    want = []
    for n, part in lines.items():
        at = 0
        for line in part:
            want.append((n, at, line[:-1].decode()))
            at += len(line)
    assert sorted(got) == sorted(want)


def test_small_pieces_share_tasks(tmp_path):
    """Ten thousand pieces make a bounded number of tasks; large pieces keep a task each."""
    (tmp_path / "a.log").write_bytes(b"x" * 9 + b"\n" + b"".join(b"line %d\n" % i for i in range(10_000)))
    reader = LogTailReader(str(tmp_path), "*.log", 10)
    now = reader.latestOffset()
    assert len(reader.partitions({}, now)) <= 64
    assert len(read_all(reader, {}, now)) == 10_001
    large = LogTailReader(str(tmp_path), "*.log", 64 << 20).partitions({}, {"a.log": {"bytes": 100 * (64 << 20), "head": 0}})
    assert len(large) == 100 and all(len(p.pieces) == 1 for p in large)


def test_replaced_files_are_read_from_their_beginning(tmp_path):
    log = tmp_path / "conn.log"
    reader = LogTailReader(str(tmp_path), "*", 100)
    log.write_text("one\ntwo\n")
    first = reader.latestOffset()
    log.write_text("new\n")
    shorter = reader.latestOffset()
    assert [r[2] for r in read_all(reader, first, shorter)] == ["new"]
    log.write_text("other\nlines\nhere\n")
    longer = reader.latestOffset()
    assert [r[2] for r in read_all(reader, shorter, longer)] == ["other", "lines", "here"]
    os.remove(log)
    assert reader.latestOffset() == {} and read_all(reader, longer, {}) == []


def test_stream_survives_a_restart(spark, tmp_path):
    live = tmp_path / "live"
    live.mkdir()
    out, mark = run_dir(spark, "stream"), run_dir(spark, "checkpoint")
    for text in ("a\nb\nc", "a\nb\nccc\n", "a\nb\nccc\nd\ne"):
        (live / "x.log").write_text(text)
        start(tail_lines(spark, f"file://{live}"), out, mark, {"availableNow": True}).awaitTermination()
    assert sorted((r["at"], r["value"]) for r in spark.read.parquet(out).collect()) == [(0, "a"), (2, "b"), (4, "ccc"), (8, "d")]


def test_keyed_sink_on_its_own_trigger(spark, tmp_path):
    (tmp_path / "m.log").write_text("x\ny\n")
    out = run_dir(spark, "topic")
    lines = tail_lines(spark, str(tmp_path), "*.log").select("value")
    running = stream_keyed_json(lines, F.lit("metrics"), run_dir(spark, "checkpoint"), out, METRIC_TRIGGER)
    running.processAllAvailable()
    running.stop()
    assert sorted(tuple(r) for r in spark.read.parquet(out).collect()) == [("metrics", '{"value":"x"}'), ("metrics", '{"value":"y"}')]


def test_event_times_of_every_shape(spark):
    texts = ["2024-01-02T03:04:05.123456+0000", "2024-01-02T03:04:05.123+00:00", "2024-01-02T03:04:05Z", "2024-01-02T04:04:05.1+0100", "soon"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "record_id long, timestamp string")
    from tidewarden.schemas import EVE_SCHEMA

    full = df.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in EVE_SCHEMA.fields if f.name != "timestamp"])
    got = [r["us"] for r in normalise_eve(full).select("record_id", F.unix_micros("ts").alias("us")).orderBy("record_id").collect()]
    second = 1704164645 * 1_000_000
    assert got == [second + 123456, second + 123000, second, second + 100000, None]
