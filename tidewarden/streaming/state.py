"""Keyed state on streams: flow windows, host context and blocks.

Rows wait in state until the watermark has passed them, then are handled in event-time order, so a stream gives
what the batch operators give on the same rows, however they arrive within the allowed delay. Rows wait as Arrow tables
by spans of time; windows, totals and blocks are found by binary search over their sorted times.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidewarden.functions.records import flow_key, micros, or_default, total_bytes, total_packets
from tidewarden.streaming.buckets import Buckets
from tidewarden.streaming.runner import use_rocksdb

MICROS_PER_MS = 1000
MINUTE = 60_000_000
# Spans of time that a window or a host's recent past is kept in.
SPANS = 64


def due_ms(at: int) -> int:
    """The first watermark (ms) that lies after a time in microseconds."""
    return at // MICROS_PER_MS + 1


def passed(watermark: int) -> int:
    """The first time in microseconds that a watermark (ms) has not passed."""
    return watermark * MICROS_PER_MS


def span_of(width: int) -> int:
    return max(MINUTE, -(-width // SPANS))


def gathered(frames: Iterator[pd.DataFrame], schema: pa.Schema) -> pa.Table:
    tables = [pa.Table.from_pandas(f[schema.names], schema=schema, preserve_index=False) for f in frames]
    return pa.concat_tables(tables) if tables else schema.empty_table()


class WaitingRows(StatefulProcessor):
    """Rows of one key that wait in spans of time; a timer brings the key back when something may be due."""

    def __init__(self, schema: T.StructType, order: list[str], span: int, sums: tuple[str, ...] = ()) -> None:
        self.schema, self.order, self.span, self.sums = to_arrow_schema(schema), order, span, sums

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = Buckets(handle, "waiting", self.schema, self.order, self.span, self.sums)
        self.timer = handle.getValueState("timer", "due long")

    def wake(self, due: int | None) -> None:
        """One timer a key: the one set before is replaced."""
        held = self.timer.get()[0] if self.timer.exists() else None
        if due == held:
            return
        if held is not None:
            self.handle.deleteTimer(held)
        if due is None:
            self.timer.clear()
        else:
            self.handle.registerTimer(due)
            self.timer.update((due,))

    def advance(self, key, watermark: int) -> Iterator[pd.DataFrame]:
        raise NotImplementedError

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.waiting.open()
        self.waiting.add(gathered(rows, self.schema))
        yield from self.advance(key, timerValues.getCurrentWatermarkInMs())
        self.waiting.save()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.timer.clear()
        self.waiting.open()
        yield from self.advance(key, timerValues.getCurrentWatermarkInMs())
        self.waiting.save()

    def close(self) -> None:
        pass


class FlowWindowProcessor(WaitingRows):
    """Anchored windows of one flow key; a window leaves once the watermark has passed its end or its last row."""

    def __init__(self, name: str, schema: T.StructType, columns: list[str], width: int, cap: int | None) -> None:
        super().__init__(schema, ["at", "record_id"], span_of(width))
        self.name, self.columns, self.width, self.cap = name, columns, width, cap

    def _look_at(self, mark: int, opened: int | None) -> tuple[int, int]:
        """The times before and after which the first window can't and can be closed, by what the index knows.

        It is over ``width`` after it was opened, or when the span is over in which its ``cap``-th row lies.
        """
        spans = self.waiting.spans
        first = (int(spans[0]) * self.span if opened is None else opened) + self.width
        if self.cap is not None:
            enough = np.flatnonzero(np.cumsum(self.waiting.rows) >= self.cap)
            if len(enough):
                full = int(spans[enough[0]]) * self.span
                return min(first, full), min(first, full + self.span)
        return first, first

    def advance(self, key, watermark: int) -> Iterator[pd.DataFrame]:
        mark = passed(watermark)
        opened = None
        if len(self.waiting.spans) and self._look_at(mark, None)[0] < mark:
            last = (mark - 1) // self.span
            rows = self.waiting.read(int(self.waiting.spans[0]), last)
            at = rows.column("at").to_numpy()
            after = np.searchsorted(at, at + self.width, side="right")
            first, starts = 0, []
            while first < len(at):
                size, end = int(after[first]) - first, int(at[first]) + self.width
                if self.cap is not None and size >= self.cap:
                    size, end = self.cap, int(at[first + self.cap - 1])
                if end >= mark:
                    opened = int(at[first])
                    break
                starts.append(first)
                first += size
            if first:
                rest = int(at[first]) // self.span if first < len(at) else last
                left = rows.slice(first)
                self.waiting.keep_from(rest, left.filter(pa.array(at[first:] // self.span == rest)))
                yield self._closed(key, rows.slice(0, first), np.array(starts))
        if not len(self.waiting.spans):
            return self.wake(None)
        self.wake(due_ms(max(mark, self._look_at(mark, opened)[1])))

    def _closed(self, key, rows: pa.Table, starts: np.ndarray) -> pd.DataFrame:
        opener = pa.array(starts[np.searchsorted(starts, np.arange(len(rows)), side="right") - 1])
        done = rows.append_column("window_at", rows.column("at").take(opener))
        frame = done.append_column("window_id", rows.column("record_id").take(opener)).to_pandas(integer_object_nulls=True)
        frame.insert(0, self.name, key[0])
        return frame[self.columns]


def stream_flow_windows(records: DataFrame, width: int, cap: int | None, late: str = "10 minutes") -> DataFrame:
    """The streaming twin of ``flow_windows``: a window's records come out together, with ``window_at`` and ``window_id``."""
    use_rocksdb(records.sparkSession)
    keyed = records.withWatermark("ts", late).withColumns({"flow_key": flow_key(), "at": micros()})
    kept = T.StructType([f for f in keyed.schema.fields if f.name not in ("flow_key", "ts")])
    out = T.StructType([keyed.schema["flow_key"], *kept.fields, T.StructField("window_at", T.LongType()), T.StructField("window_id", T.LongType())])
    windowed = keyed.groupBy("flow_key").transformWithStateInPandas(
        FlowWindowProcessor("flow_key", kept, out.names, width, cap), out, "Append", "EventTime"
    )
    return windowed.withColumn("ts", F.timestamp_micros("at"))


HOST_ROW = T.StructType([
    T.StructField(n, T.StringType() if n == "dst_ip" else T.LongType()) for n in ("at", "record_id", "bytes", "packets", "dst_ip", "dst_port")
])


class HostContextProcessor(WaitingRows):
    """Distinct destinations so far and totals of the last ``width`` for each record of one host, in event time.

    A record is answered once the watermark has passed it, so all that happened before it is known. Sums over whole
    spans come from the index; only the spans in which records are answered, and those in which their recent past
    begins, are read. Destinations keep the time of their first contact. With ``idle`` (``width`` at least), a host that is
    silent for longer in event time is forgotten, and its distinct counts begin anew.
    """

    OUT = ["src_ip", "record_id", "unique_dst_ips", "unique_dst_ports", "recent_flows", "recent_bytes", "recent_packets"]

    def __init__(self, width: int, idle: int | None) -> None:
        super().__init__(HOST_ROW, ["at", "record_id"], span_of(width), ("bytes", "packets"))
        self.width, self.idle = width, idle if idle is None else max(idle, width)

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.known = handle.getMapState("known", "dst string", "first long")
        # Destinations so far, the time up to which records are answered, and the last answered one's time.
        self.totals = handle.getValueState("totals", "ips long, ports long, answered long, last long")

    def advance(self, key, watermark: int) -> Iterator[pd.DataFrame]:
        mark = passed(watermark)
        ips, ports, answered, last = self.totals.get() if self.totals.exists() else (0, 0, -(1 << 62), -(1 << 62))
        if mark > answered:
            ready = self.waiting.read(answered // self.span, (mark - 1) // self.span)
            at = ready.column("at").to_numpy()
            ready = ready.slice(int(np.searchsorted(at, answered)), int(np.searchsorted(at, mark) - np.searchsorted(at, answered)))
            for silent, part in self._stretches(ready, last):
                if silent:
                    self.known.clear()
                    ips, ports = 0, 0
                times = part.column("at").to_numpy()
                first_ips = self._first_contacts("ip", part, "dst_ip", "")
                first_ports = self._first_contacts("port", part, "dst_port", 0)
                yield pd.DataFrame({
                    "src_ip": key[0], "record_id": part.column("record_id").to_numpy(),
                    "unique_dst_ips": ips + np.searchsorted(first_ips, times, side="right"),
                    "unique_dst_ports": ports + np.searchsorted(first_ports, times, side="right"),
                    **dict(zip(self.OUT[4:], self._until(times) - self._until(times - self.width))),
                })[self.OUT]
                ips, ports, last = ips + len(first_ips), ports + len(first_ports), int(times[-1])
            answered = mark
        self.waiting.drop_before((answered - self.width) // self.span)
        self.totals.update((ips, ports, answered, last))
        unanswered = self.waiting.first_from(answered)
        if unanswered is not None:
            self.wake(due_ms(unanswered))
        elif self.idle is None:
            self.wake(None)
        elif answered > last + self.idle:
            for state in (self.known, self.totals):
                state.clear()
            self.waiting.clear()
            self.wake(None)
        else:
            self.wake(due_ms(last + self.idle))

    def _stretches(self, rows: pa.Table, last: int) -> Iterator[tuple[bool, pa.Table]]:
        """Ordered rows without a silence of ``idle`` among them, and whether one came before."""
        at = rows.column("at").to_numpy()
        gaps = np.diff(np.concatenate(([last], at))) > self.idle if self.idle is not None else np.zeros(len(at), bool)
        cuts = sorted({0, *np.flatnonzero(gaps).tolist(), len(at)})
        for first, after in zip(cuts, cuts[1:]):
            yield bool(gaps[first]), rows.slice(first, after - first)

    def _first_contacts(self, kind: str, rows: pa.Table, column: str, empty) -> np.ndarray:
        """When destinations that were never met before are first met, in order."""
        met = rows.group_by(column).aggregate([("at", "min")])
        found = []
        for name, first in zip(met.column(column).to_pylist(), met.column("at_min").to_pylist()):
            if name and name != empty and not self.known.containsKey((f"{kind} {name}",)):
                self.known.updateValue((f"{kind} {name}",), (first,))
                found.append(first)
        return np.sort(np.array(found, np.int64))

    def _until(self, times: np.ndarray) -> np.ndarray:
        """Records, bytes and packets that the state holds up to each of the ordered times."""
        sums = self.waiting.index[:, 1:]
        whole = np.vstack([np.zeros((1, 3), np.int64), np.cumsum(sums, axis=0)])
        span = times // self.span
        before = whole[np.searchsorted(self.waiting.spans, span)]
        rows = self.waiting.read(int(span[0]), int(span[-1]))
        at = rows.column("at").to_numpy()
        parts = [np.ones(len(at), np.int64), rows.column("bytes").to_numpy(), rows.column("packets").to_numpy()]
        running = np.vstack([np.zeros((1, 3), np.int64), np.cumsum(np.stack(parts, axis=1), axis=0)])
        inside = running[np.searchsorted(at, times, side="right")] - running[np.searchsorted(at, span * self.span)]
        return (before + inside).T


def stream_host_context(records: DataFrame, width: int, late: str = "10 minutes", idle_hours: int | None = None) -> DataFrame:
    """Host context per record, as ``distinct_so_far`` and ``trailing_totals`` give it: a record is answered when the watermark has
    passed it, so records that arrive out of order within ``late`` count in event order. With ``idle_hours``, a host is
    forgotten after such a silence, which bounds the state but lets its distinct counts begin anew."""
    idle = None if idle_hours is None else idle_hours * 3_600_000_000
    use_rocksdb(records.sparkSession)
    slim = records.withWatermark("ts", late).filter(or_default("src_ip", "") != "").select(
        "src_ip", "ts", micros().alias("at"), "record_id", total_bytes().alias("bytes"), total_packets().alias("packets"),
        or_default("dst_ip", "").alias("dst_ip"), or_default("dst_port", 0).cast("long").alias("dst_port"),
    )
    schema = "src_ip string, record_id long, unique_dst_ips long, unique_dst_ports long, recent_flows long, recent_bytes long, recent_packets long"
    return slim.groupBy("src_ip").transformWithStateInPandas(
        HostContextProcessor(width, idle), schema, "Append", "EventTime"
    )


ACT_ROW = T.StructType([
    *[T.StructField(n, T.LongType()) for n in ("at", "result_id", "rank", "step")],
    T.StructField("act", T.StringType()), T.StructField("policy_name", T.StringType()),
])


class BlockProcessor(WaitingRows):
    """Block life cycle of one address; an interval leaves when it ends. The loop steps from block to block, not from row to row."""

    OUT = ["ip", "policy_name", "blocked_at", "expires_at", "ended_at", "result_id"]

    def __init__(self, length: int) -> None:
        super().__init__(ACT_ROW, ["at", "result_id", "rank", "step"], span_of(length))
        self.length = length

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.block = handle.getValueState("block", "blocked_at long, expires_at long, result_id long, policy_name string")

    def advance(self, key, watermark: int) -> Iterator[pd.DataFrame]:
        mark = passed(watermark)
        held = self.waiting.spans
        rows = self.waiting.read(int(held[0]), (mark - 1) // self.span) if len(held) else self.schema.empty_table()
        at = rows.column("at").to_numpy()
        n = int(np.searchsorted(at, mark))
        block, ended = self._followed(tuple(self.block.get()) if self.block.exists() else None, rows.slice(0, n), at[:n])
        if n:
            span = (mark - 1) // self.span
            self.waiting.keep_from(span, rows.slice(n))
        if block is not None and block[1] < mark:
            ended.append((*block, block[1]))
            block = None
        self.block.update(block) if block is not None else self.block.clear()
        dues = [t for t in (self.waiting.first_from(mark), block and block[1]) if t is not None]
        self.wake(due_ms(min(dues)) if dues else None)
        if ended:
            names = ["blocked_at", "expires_at", "result_id", "policy_name", "ended_at"]
            yield pd.DataFrame(ended, columns=names).assign(ip=key[0])[self.OUT]

    def _followed(self, block: tuple | None, rows: pa.Table, at: np.ndarray) -> tuple[tuple | None, list[tuple]]:
        """The block that holds after the ordered rows, and those that ended by them."""
        allows = np.flatnonzero(pc.equal(rows.column("act"), "allow").to_numpy())
        attempts = np.flatnonzero(pc.equal(rows.column("act"), "block_ip").to_numpy())
        ended, here = [], 0
        while True:
            if block is None:
                k = np.searchsorted(attempts, here)
                if k == len(attempts):
                    return None, ended
                row = int(attempts[k])
                start = int(at[row])
                block = (start, start + self.length, rows.column("result_id")[row].as_py(), rows.column("policy_name")[row].as_py())
                here = row + 1
            over = int(np.searchsorted(at, block[1]))  # the first row at which it no longer holds
            k = np.searchsorted(allows, here)
            if k < len(allows) and allows[k] < over:
                ended.append((*block, int(at[allows[k]])))
                here = int(allows[k]) + 1
            elif over < len(at):
                ended.append((*block, block[1]))
                here = max(here, over)
            else:
                return block, ended
            block = None


def stream_blocks(actions: DataFrame, seconds: int, late: str = "10 minutes") -> DataFrame:
    """The streaming twin of ``block_intervals``."""
    use_rocksdb(actions.sparkSession)
    acts = actions.filter(F.col("act").isin("block_ip", "allow")).withWatermark("timestamp", late)
    slim = acts.select(
        F.col("src_ip").alias("ip"), "timestamp", micros("timestamp").alias("at"), "result_id", F.col("rank").cast("long").alias("rank"),
        F.col("step").cast("long").alias("step"), "act", "policy_name")
    schema = "ip string, policy_name string, blocked_at long, expires_at long, ended_at long, result_id long"
    return slim.groupBy("ip").transformWithStateInPandas(BlockProcessor(seconds * 1_000_000), schema, "Append", "EventTime")
