"""Running totals per key that stay parallel when one key holds most of the rows.

A plain window sorts a whole key in one task. Here a key's timeline is cut into slices, each slice is summed on
its own, and the slices' totals (one small row per key and slice, reduced before the shuffle) give each slice
its offset. Sliding sums become differences of two running totals, so no frame is ever rescanned.

Slices are bounded by volume: a slice of the timeline that holds more than ``SLICE_ROWS`` rows is cut further at
places of the order that a sample drawn by hash names, so rows that crowd into one minute, or into one moment,
are spread like any others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewarden.session import BROADCAST_ROWS, materialize

# Rows of one slice at most, but for the chance of the sample; cuts aim at half of it.
SLICE_ROWS = 500_000
SAMPLED = 32  # rows of the sample for each cut


def _cut_places(rows: DataFrame, cells: DataFrame, order: list[str], slice_rows: int) -> DataFrame:
    """For each crowded cell, about two cuts for every ``slice_rows`` of its rows, in groups of equal size."""
    every = max(1, slice_rows // (2 * SAMPLED))
    drawn = rows.filter(F.pmod(F.xxhash64(*order), F.lit(every)) == 0).join(cells.select("_key"), "_key")
    places = F.array_sort(F.collect_list(F.struct(*order)))
    cuts = drawn.groupBy("_key").agg(places.alias("_p")).select(
        "_key", F.filter("_p", lambda _, i: i % SAMPLED == SAMPLED - 1).alias("_p")).filter(F.size("_p") > 0)
    step = F.ceil(F.sqrt(F.size("_p"))).cast("int")
    groups = F.transform(F.sequence(F.lit(1), F.size("_p"), F.col("_step")), lambda i: F.slice("_p", i, F.col("_step")))
    return cuts.withColumn("_step", step).select("_key", "_step", groups.alias("_groups"))


def _cut_number(order: list[str]) -> Column:
    """How many cuts of its cell lie at or before a row: first among the groups, then inside one."""
    here = F.struct(*order)
    reached = F.size(F.filter("_groups", lambda g: F.get(g, F.lit(0)) <= here))
    inside = F.size(F.filter(F.get("_groups", reached - 1), lambda c: c <= here))
    return F.when(reached > 0, (reached - 1) * F.col("_step") + inside).otherwise(F.lit(0))


def sliced_totals(
    df: DataFrame, keys: list[str], order: list[str], sums: list[str], slice_width: int, slice_rows: int = SLICE_ROWS
) -> tuple[DataFrame, DataFrame]:
    """``df`` with ``_key`` (``keys``, ``_slice`` and ``_cut``), and for each ``_key`` its rows ``_n`` and the sums of columns.

    Nulls in a key are equal, and rows without a place in the order come first.
    """
    place = F.floor(F.col(order[0]) / F.lit(slice_width)).alias("_slice")
    totals = [F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(c) for c in sums]]
    sliced = df.withColumn("_key", F.struct(*keys, place, F.lit(0).alias("_cut")))
    cells = materialize(sliced.groupBy("_key").agg(*totals))
    crowded = cells.filter(F.col("_n") > slice_rows)
    if crowded.isEmpty():
        return sliced, cells
    cuts = materialize(_cut_places(sliced, crowded, order, slice_rows))
    if (cuts.agg(F.sum(F.size("_groups") * F.col("_step"))).first()[0] or 0) <= BROADCAST_ROWS:
        cuts = F.broadcast(cuts)
    cut = F.when(F.col("_groups").isNotNull(), _cut_number(order)).otherwise(F.lit(0)).cast("int")
    placed = sliced.join(cuts, "_key", "left").withColumn("_key", F.col("_key").withField("_cut", cut)).drop("_groups", "_step")
    return placed, materialize(placed.groupBy("_key").agg(*totals))


def running_totals(
    df: DataFrame, keys: list[str], order: list[str], totals: dict[str, Column], slice_width: int, slice_rows: int = SLICE_ROWS
) -> DataFrame:
    """Add inclusive running totals per ``keys`` in ``order``; ``order[0]`` is a number that also cuts the slices.

    Key and slice are joined as one struct, in which nulls are equal: rows with a null key, or without a place in
    the order, are summed like any other (the latter first) and none is lost.
    """
    names = list(totals)
    values = {f"_v_{n}": c.cast("long") for n, c in totals.items()}
    sliced, cells = sliced_totals(df.withColumns(values), keys, order, list(values), slice_width, slice_rows)
    within = Window.partitionBy("_key").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*[F.col("_key")[k] for k in keys]).orderBy("_key._slice", "_key._cut").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cells.select("_key", *[F.coalesce(F.sum(f"_v_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in names])
    local = sliced.select(*df.columns, "_key", *[F.sum(f"_v_{n}").over(within).alias(f"_l_{n}") for n in names])
    return local.join(offsets, "_key").select(
        *df.columns, *[(F.col(f"_l_{n}") + F.col(f"_o_{n}")).alias(n) for n in names]
    )


def totals_between(
    events: DataFrame,
    probes: DataFrame,
    keys: list[str],
    probe_id: list[str],
    totals: dict[str, Column],
    slice_width: int,
    since_start: tuple[str, ...] = (),
    since: str = "since",
    until: str = "until",
    at: str = "at",
) -> DataFrame:
    """For each probe, the totals of its key's events with ``since < at <= until``.

    Totals named in ``since_start`` ignore the lower bound. Every probe comes back, with zeros where nothing
    falls inside.
    Cost is one sort of events plus the probes' marks, whatever the width of the interval: an upper one, and a lower
    one if some total needs it.
    """
    names = list(totals)
    upper = F.struct(F.col(until).alias("at"), F.lit(1).alias("sign"))
    lower = F.struct(F.col(since).alias("at"), F.lit(-1).alias("sign"))
    mark = F.array(upper, lower) if set(names) - set(since_start) else F.array(upper)
    adds = events.select(
        *keys, F.col(at).alias("_at"), F.lit(0).alias("_sign"),
        *[c.cast("long").alias(n) for n, c in totals.items()],
    )
    marks = probes.select(*keys, *probe_id, F.explode(mark).alias("_m")).select(
        *keys, *probe_id, F.col("_m.at").alias("_at"), F.col("_m.sign").alias("_sign")
    )
    both = adds.unionByName(marks, allowMissingColumns=True).withColumn("_late", (F.col("_sign") != 0).cast("int"))
    summed = running_totals(
        both, keys, ["_at", "_late"], {f"_r_{n}": F.coalesce(F.col(n), F.lit(0)) for n in names}, slice_width
    )

    def weight(name: str) -> Column:
        return (F.col("_sign") > 0).cast("int") if name in since_start else F.col("_sign")

    return (
        summed.filter("_sign != 0")
        .groupBy(*keys, *probe_id)
        .agg(*[F.sum(weight(n) * F.col(f"_r_{n}")).alias(n) for n in names])
    )
