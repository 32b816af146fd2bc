import zlib

import numpy as np
import pyarrow as pa
import pytest

from tidewarden.llm import resampling
from tidewarden.llm.checksums import checksums, joined


@pytest.mark.parametrize("size", [0, 1, 3, 63, 64, 65, 1000, 70_000])
def test_joined_checksums(size):
    random = np.random.default_rng(size)
    left, right = random.bytes(19), random.bytes(size)
    assert joined(checksums([left]), checksums([right]), np.array([size]))[0] == zlib.crc32(left + right)


def test_runs_by_hand():
    counts, rows, buckets = resampling.run_buckets(pa.array(["Ab-c  ÉÀ1", None, "", "x"]))
    want = ["ab", "c", "ÉÀ1", "ab c", "c ÉÀ1", "ab c ÉÀ1"]
    assert counts.tolist() == [3, 0, 0, 1]
    assert sorted(buckets[rows == 0].tolist()) == sorted(zlib.crc32(w.encode()) % resampling.BUCKETS for w in want)
    assert buckets[rows == 3].tolist() == [zlib.crc32(b"x") % resampling.BUCKETS]


@pytest.mark.parametrize("wanted", [0, 1, 7, 40, 41, 55, 90, 119, 120])
def test_ties_are_drawn_by_id_and_then_by_row(spark, wanted):
    """Two thirds of the rows share one score, half of them one id."""
    random = np.random.default_rng(5)
    rows = [(int(random.integers(-50, 50)) if k % 3 == 0 else 4, 9 if k % 2 else int(random.integers(-(2**62), 2**62)), k) for k in range(120)]
    table = spark.createDataFrame(rows, "place long, tie long, row long").repartition(5)
    got = resampling.ranked(table.filter(resampling.drawn(table, wanted))).collect()
    want = {r: k + 1 for k, r in enumerate(sorted(rows)[:wanted])}
    assert {(r["place"], r["tie"], r["row"]): r["rank"] for r in got} == want


def test_odd_rows_and_copies(spark, odd, docs):
    target = docs([(1, "same text")])
    got = resampling.resample(odd, target, percent=50, min_words=0).collect()
    assert len(got) == 10 and sorted(r["rank"] for r in got if r["rank"]) == [1, 2, 3, 4, 5]
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[1]["n_features"] == by_id[2]["n_features"] == by_id[3]["weight"] == 0
    assert by_id[5]["n_features"] == by_id[6]["n_features"] == 3 * 6000 - 3 and by_id[5]["weight"] == by_id[6]["weight"]
    drawn = resampling.sample(docs([(k, f"same text {k}") for k in range(10)]), target, min_words=0, percent=30).collect()
    assert len(drawn) == 3 and all(r["row"] == "mine" and r["n_words"] == 7 for r in drawn)


def test_empty_tables(spark, empty, docs):
    assert resampling.resample(empty, docs([(1, "a b")])).count() == 0
    got = resampling.resample(docs([(1, "a b c")]), empty, min_words=1, percent=100).collect()
    assert [(r["n_features"], r["rank"]) for r in got] == [(6, 1)]
