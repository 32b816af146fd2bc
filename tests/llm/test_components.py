"""Connected components against a plain version, with hubs that no join may gather in one task."""

import random

import pytest

from tidewarden.llm.components import connected_components

SPLITS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
}


def plain_components(edges):
    root = {n: n for e in edges for n in e}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for e in edges if e[0] != e[1] for n in e}


def found(spark, edges):
    table = spark.createDataFrame(edges, "a long, b long").repartition(8)
    rows = [(r["node"], r["root"]) for r in connected_components(table).collect()]
    assert len(rows) == len(dict(rows))
    return dict(rows)


@pytest.fixture
def splitting(spark):
    before = {k: spark.conf.get(k, None) for k in SPLITS}
    for k, v in SPLITS.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


@pytest.mark.parametrize("seed", [1, 2])
def test_random_edges_loops_and_repeats(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(-100, 200), rng.randrange(-100, 200)) for _ in range(150)]
    edges += edges[:20] + [(b, a) for a, b in edges[20:40]] + [(7, 7), (999, 999)]
    assert found(spark, edges) == plain_components(edges)


def test_a_chain_and_no_edges(spark):
    assert set(found(spark, [(k, k + 1) for k in range(400)]).values()) == {0}
    assert found(spark, [(1, 1)]) == {} and connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_hubs_are_split_and_stay_whole(spark, splitting):
    hubs = [(500_000, 3 * k) for k in range(1, 20_000)] + [(700_000, 900_000 + k) for k in range(3000)] + [(700_000, 3)]
    edges = hubs + [(2_000_000 + k, 2_000_001 + k) for k in range(0, 3000, 2)]
    assert found(spark, edges) == plain_components(edges)
