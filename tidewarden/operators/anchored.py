"""Anchored windows: a window opens at its first row and closes by age or by count.

The next window's start depends on the previous one, so the assignment is a chain of jumps per key. Keys of
ordinary size are cut at gaps longer than the width and folded as short arrays (one shuffle on the key). Keys
above ``hot_rows`` never meet in one task: their rows are numbered and cut into blocks, each block is turned into a
function from where it is entered to where the next one is, and the functions are composed (``chained``). Only if a
single window may hold more rows than a block, the chain is followed from the first row by pointer doubling, which takes
log2(windows) joins on (key, position) with no skew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewarden.operators.chained import BLOCK_ROWS, chained_windows, longest_window
from tidewarden.operators.running import running_totals
from tidewarden.session import broadcast_if_small, materialize

# Array folds stay below this many rows of one key.
HOT_ROWS = 20_000
# Rows of one task that gives busy keys' rows their windows.
TASK_ROWS = 250_000


def anchored_windows(
    df: DataFrame,
    keys: list[str],
    at: str,
    row_id: str,
    width: int,
    cap: int | None = None,
    hot_rows: int = HOT_ROWS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Add ``window_at`` and ``window_id``: ``at`` and ``row_id`` of the row that opened the row's window.

    A row opens a window if the open one is older than ``width`` (strictly) or already holds ``cap`` rows.
    ``row_id`` must be unique; rows are ordered by (``at``, ``row_id``). A missing time counts as 0.
    """
    return _windows(df, keys, at, row_id, width, cap, hot_rows, block_rows, False)


def anchored_starts(
    df: DataFrame,
    keys: list[str],
    at: str,
    row_id: str,
    width: int,
    cap: int | None = None,
    hot_rows: int = HOT_ROWS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Only the rows that open a window, unchanged; the others are never placed."""
    return _windows(df, keys, at, row_id, width, cap, hot_rows, block_rows, True).drop("window_at", "window_id")


def _windows(
    df: DataFrame, keys: list[str], at: str, row_id: str, width: int, cap: int | None, hot_rows: int, block_rows: int, starts: bool
) -> DataFrame:
    timed = df.withColumn("_timed", F.coalesce(F.col(at), F.lit(0)))
    busy_keys = timed.withColumn("_of", F.struct(*keys)).groupBy("_of").agg(F.count(F.lit(1)).alias("_rows"))
    hot = materialize(busy_keys.filter(F.col("_rows") > hot_rows))
    most, rows = hot.agg(F.max("_rows"), F.sum("_rows")).first()
    if most is None:
        return _fold(timed, keys, "_timed", row_id, width, cap, starts).drop("_timed")
    hot = broadcast_if_small(hot.select("_of"))
    named = timed.withColumn("_of", F.struct(*keys))  # null keys are equal inside the struct
    cold = _fold(named.join(hot, "_of", "left_anti").drop("_of"), keys, "_timed", row_id, width, cap, starts)
    busy = _busy(named.join(hot, "_of", "left_semi"), row_id, width, cap, most, rows, block_rows, starts)
    return cold.unionByName(busy.drop("_of")).drop("_timed")


def _busy(
    df: DataFrame, row_id: str, width: int, cap: int | None, most: int, total: int, block_rows: int, starts: bool
) -> DataFrame:
    """Windows of the keys (``_of``) that are never gathered; ``most`` is the rows of the largest, ``total`` those of all.

    Rows meet their windows in tasks of a bounded number of rows: beside the other keys' fat arrays, sizes in bytes would
    give them too few.
    """
    slim = df.select("_of", "_timed", row_id)
    several = most > block_rows
    reach = cap if cap is not None and cap <= block_rows else longest_window(slim, "_timed", width) if several else block_rows
    if reach > block_rows:
        placed = _chase(slim, ["_of"], "_timed", row_id, width, cap)
        placed = placed.filter(F.col(row_id) == F.col("window_id")) if starts else placed
    else:
        placed = chained_windows(slim, "_timed", row_id, width, cap, reach, several, starts, block_rows).withColumnRenamed("id", row_id)
    tasks = -(-total // TASK_ROWS)
    dealt, found = (x.repartition(tasks, "_of", row_id) for x in (df, placed.select("_of", row_id, "window_at", "window_id")))
    return dealt.join(found, ["_of", row_id]).select(*df.columns, "window_at", "window_id")


def _opens(acc: Column, row: Column, at: str, width: int, cap: int | None) -> Column:
    old = row[at] - acc["opened"] > F.lit(width)
    return old if cap is None else old | (acc["held"] >= F.lit(cap))


def _starts(rows: Column, at: str, width: int, cap: int | None) -> Column:
    """0-based indexes in the sorted array at which a window opens."""
    first = F.struct(
        F.get(rows, F.lit(0))[at].alias("opened"), F.lit(0).alias("held"), F.lit(0).alias("seen"),
        F.array(F.lit(0)).alias("starts"),
    )

    def step(acc: Column, row: Column) -> Column:
        new = _opens(acc, row, at, width, cap)
        return F.struct(
            F.when(new, row[at]).otherwise(acc["opened"]).alias("opened"),
            F.when(new, F.lit(1)).otherwise(acc["held"] + 1).alias("held"),
            (acc["seen"] + 1).alias("seen"),
            F.when(new, F.concat(acc["starts"], F.array(acc["seen"]))).otherwise(acc["starts"]).alias("starts"),
        )

    one_window = F.element_at(rows, -1)[at] - F.get(rows, F.lit(0))[at] <= F.lit(width)
    if cap is not None:
        one_window = one_window & (F.size(rows) <= cap)
    return F.when(one_window, F.array(F.lit(0))).otherwise(F.aggregate(rows, first, step, lambda acc: acc["starts"]))


def _fold(df: DataFrame, keys: list[str], at: str, row_id: str, width: int, cap: int | None, only_starts: bool) -> DataFrame:
    rest = [c for c in df.columns if c not in (*keys, at, row_id)]
    by_key = Window.partitionBy(*keys).orderBy(at, row_id)
    gap = F.col(at) - F.lag(at).over(by_key) > width
    sessions = df.withColumn("_new", F.coalesce(gap, F.lit(False)).cast("int")).withColumn(
        "_session", F.sum("_new").over(by_key.rowsBetween(Window.unboundedPreceding, 0))
    )
    grouped = (
        sessions.groupBy(*keys, "_session")
        .agg(F.array_sort(F.collect_list(F.struct(at, row_id, *rest))).alias("_rows"))
        .withColumn("_starts", _starts(F.col("_rows"), at, width, cap))
    )
    rows, starts = F.col("_rows"), F.col("_starts")
    if only_starts:
        opening = grouped.select(*keys, F.inline(F.transform(starts, lambda s: F.get(rows, s))))
        return opening.select(*df.columns, F.col(at).alias("window_at"), F.col(row_id).alias("window_id"))
    windows = F.transform(
        starts,
        lambda s, i: F.struct(
            F.get(rows, s)[at].alias("window_at"),
            F.get(rows, s)[row_id].alias("window_id"),
            F.slice(rows, s + 1, F.coalesce(F.get(starts, i + 1), F.size(rows)) - s).alias("members"),
        ),
    )
    return (
        grouped.select(*keys, F.inline(windows))
        .select(*keys, "window_at", "window_id", F.inline("members"))
        .select(*df.columns, "window_at", "window_id")
    )


def _chase(df: DataFrame, keys: list[str], at: str, row_id: str, width: int, cap: int | None) -> DataFrame:
    slim = df.select(*keys, at, row_id)
    probes = slim.select(*keys, (F.col(at) + width).alias(at), row_id, F.lit(1).alias("_probe"))
    counted = running_totals(
        slim.withColumn("_probe", F.lit(0)).unionByName(probes),
        keys, [at, "_probe", row_id], {"_n": F.lit(1) - F.col("_probe")}, slice_width=max(4 * width, 1),
    )
    own, ahead = F.col("_probe") == 0, F.col("_probe") == 1
    aged_out = F.max(F.when(ahead, F.col("_n"))) + 1
    nodes = counted.groupBy(*keys, row_id).agg(
        F.max(F.when(own, F.col(at))).alias(at),
        F.max(F.when(own, F.col("_n"))).alias("_pos"),
        aged_out.alias("_aged_out"),
    )
    full = F.col("_pos") + cap if cap is not None else F.col("_aged_out")
    nodes = materialize(nodes.withColumn("_next", F.least("_aged_out", full)).drop("_aged_out"))

    reached = nodes.filter("_pos = 1").select(*keys, "_pos")
    jump = nodes.select(*keys, "_pos", "_next")
    while not jump.isEmpty():
        onward = reached.join(jump, [*keys, "_pos"]).select(*keys, F.col("_next").alias("_pos"))
        reached = materialize(reached.unionByName(onward))
        further = jump.select(*keys, F.col("_pos").alias("_next"), F.col("_next").alias("_then"))
        jump = materialize(jump.join(further, [*keys, "_next"]).select(*keys, "_pos", F.col("_then").alias("_next")))

    opened = nodes.join(reached, [*keys, "_pos"]).select(
        *keys,
        F.col(at).alias("window_at"),
        F.col(row_id).alias("window_id"),
        F.explode(F.sequence("_pos", F.col("_next") - 1)).alias("_pos"),
    )
    placed = nodes.select(*keys, "_pos", row_id).join(opened, [*keys, "_pos"]).drop("_pos")
    return placed
