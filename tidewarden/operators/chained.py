"""Anchored windows of keys too large for one task, by blocks that are chained like functions.

A key's rows are numbered and cut into blocks of equal size. Where a window opens in a block decides all later windows
of the block and the row at which the first window of the next block opens, and that row is one of the next block's
first ``reach`` rows, if no window holds more than that. So a block is a function on ``reach`` entries, found in one task
without knowing any other block. Functions of neighbouring blocks are composed in groups, the groups are followed
from the key's first row, and with its entry known each block places its windows. Every row is moved a fixed number of
times, whatever the number of windows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewarden.operators.running import running_totals
from tidewarden.session import materialize

BLOCK_ROWS = 500_000
GROUP_BLOCKS = 256


def longest_window(rows: DataFrame, at: str, width: int) -> int:
    """A bound on the rows of one key (``_of``) within ``width``: those of two neighbouring cells of the timeline."""
    cells = rows.groupBy("_of", F.floor(F.col(at) / F.lit(width + 1)).alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    following = Window.partitionBy("_of").orderBy("cell")
    pair = F.col("n") + F.when(F.lead("cell").over(following) == F.col("cell") + 1, F.lead("n").over(following)).otherwise(F.lit(0))
    return cells.select(pair.alias("n")).agg(F.max("n")).first()[0] or 0


def blocks_of(rows: DataFrame, at: str, row_id: str, width: int, reach: int, block_rows: int) -> DataFrame:
    """Rows (``_of``, ``at``, ``row_id``) with their ``block`` and ``offset``; a block also sees the next one's first ``reach`` rows."""
    numbered = running_totals(rows, ["_of"], [at, row_id], {"_pos": F.lit(1)}, max(4 * width, 1))
    place, offset = F.floor((F.col("_pos") - 1) / block_rows), (F.col("_pos") - 1) % block_rows
    own = F.struct(place.alias("block"), offset.alias("offset"))
    ahead = F.when((place > 0) & (offset < reach), F.struct((place - 1).alias("block"), (offset + block_rows).alias("offset")))
    return numbered.select("_of", F.col(at).alias("at"), F.col(row_id).alias("id"), F.inline(F.array_compact(F.array(own, ahead))))


def _opening_after(at: np.ndarray, width: int, cap: int | None) -> np.ndarray:
    """Where the next window opens, if one opens at each of the ordered rows."""
    after = np.searchsorted(at, at + width, side="right")
    return after if cap is None else np.minimum(after, np.arange(len(at)) + cap)


def _ordered(block: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(block.column("offset").to_numpy())
    return order, block.column("at").to_numpy()[order]


def exits(block_rows: int, reach: int, width: int, cap: int | None) -> Callable[[pa.Table], pa.Table]:
    """The function of a block: for each entry, where the next block is entered."""

    def compute(block: pa.Table) -> pa.Table:
        _, at = _ordered(block)
        own = min(len(at), block_rows)
        jump = np.arange(len(at) + 1)
        jump[:own] = _opening_after(at, width, cap)[:own]
        while True:
            further = jump[jump]
            if (further == jump).all():
                break
            jump = further
        found = np.zeros(reach, np.int32)
        found[: min(own, reach)] = jump[: min(own, reach)] - block_rows  # below 0 only in a key's last block
        return pa.table({"_of": block.column("_of")[:1], "block": block.column("block")[:1], "exits": pa.array([found.tobytes()], pa.binary())})

    return compute


def _functions(table: pa.Table, number: str) -> list[tuple[int, np.ndarray]]:
    rows = zip(table.column(number).to_pylist(), table.column("exits").to_pylist())
    return sorted(((n, np.frombuffer(f, np.int32)) for n, f in rows), key=lambda r: r[0])


def _composed(group: pa.Table) -> pa.Table:
    """The function of a whole group of neighbouring blocks."""
    functions = [f for _, f in _functions(group, "block")]
    whole = functions[0]
    for f in functions[1:]:
        whole = f[np.maximum(whole, 0)]
    return pa.table({"_of": group.column("_of")[:1], "group": group.column("group")[:1], "exits": pa.array([whole.tobytes()], pa.binary())})


def _followed(number: str) -> Callable[[pa.Table], pa.Table]:
    """The entry of each function, in order, from the entry of the first."""

    def follow(table: pa.Table) -> pa.Table:
        at = table.column("entry")[0].as_py() if "entry" in table.column_names else 0
        numbers, entries = [], []
        for n, f in _functions(table, number):
            numbers.append(n)
            entries.append(at)
            at = max(int(f[at]), 0)
        key = table.column("_of").take(pa.array(np.zeros(len(numbers), np.int64)))
        return pa.table({"_of": key, number: pa.array(numbers, pa.int64()), "entry": pa.array(entries, pa.int64())})

    return follow


def entries(functions: DataFrame) -> DataFrame:
    """``_of``, ``block`` and the ``entry`` at which its first own window opens."""
    key = T.StructField("_of", functions.schema["_of"].dataType)
    entry, group, block = (T.StructField(n, T.LongType()) for n in ("entry", "group", "block"))
    grouped = functions.withColumn("group", F.floor(F.col("block") / GROUP_BLOCKS))
    whole = grouped.groupBy("_of", "group").applyInArrow(_composed, T.StructType([key, group, T.StructField("exits", T.BinaryType())]))
    of_groups = whole.groupBy("_of").applyInArrow(_followed("group"), T.StructType([key, group, entry]))
    known = grouped.join(of_groups, ["_of", "group"])
    return known.groupBy("_of", "group").applyInArrow(_followed("block"), T.StructType([key, block, entry]))


def placements(block_rows: int, width: int, cap: int | None, starts_only: bool) -> Callable[[pa.Table], pa.Table]:
    """The rows from a block's entry to the next one's, or only those that open a window, with what opened their window."""

    def place(block: pa.Table) -> pa.Table:
        order, at = _ordered(block)
        own = min(len(at), block_rows)
        following = _opening_after(at, width, cap).tolist()
        step, starts = block.column("entry")[0].as_py(), []
        while step < own:
            starts.append(step)
            step = following[step]
        opened = np.array(starts, np.int64)
        rows = opened if starts_only else np.arange(starts[0] if starts else 0, step if starts else 0)
        by = opened[np.searchsorted(opened, rows, side="right") - 1] if len(rows) else rows
        ids = block.column("id")
        return pa.table({
            "_of": block.column("_of").take(pa.array(order[rows])), "id": ids.take(pa.array(order[rows])),
            "window_at": pa.array(at[by]), "window_id": ids.take(pa.array(order[by])),
        })

    return place


def chained_windows(
    rows: DataFrame, at: str, row_id: str, width: int, cap: int | None, reach: int, several: bool, starts_only: bool,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``_of``, ``id``, ``window_at``, ``window_id`` of rows (``_of``, ``at``, ``row_id``), or only of those that open a window.

    ``reach`` bounds the rows of a window, and no block is smaller; without ``several`` blocks in any key nothing is chained.
    """
    placed = materialize(blocks_of(rows, at, row_id, width, reach, block_rows))
    key, number = T.StructField("_of", placed.schema["_of"].dataType), T.StructField("block", T.LongType())
    if several:
        found = placed.groupBy("_of", "block").applyInArrow(
            exits(block_rows, reach, width, cap), T.StructType([key, number, T.StructField("exits", T.BinaryType())]))
        entered = placed.join(materialize(entries(materialize(found))), ["_of", "block"])
    else:
        entered = placed.withColumn("entry", F.lit(0).cast("long"))
    one = placed.schema["id"].dataType
    shape = T.StructType([key, T.StructField("id", one), T.StructField("window_at", T.LongType()), T.StructField("window_id", one)])
    return entered.groupBy("_of", "block").applyInArrow(placements(block_rows, width, cap, starts_only), shape)
