"""Rows of one key in state, as Arrow tables by spans of event time.

A map from span number to a sorted table holds the rows; a small index names the spans in order with their row counts
and sums. Arriving rows rewrite only the spans they fall into, and readers load only the spans they name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql.streaming import StatefulProcessorHandle


def _packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table.combine_chunks())
    return sink.getvalue().to_pybytes()


class Buckets:
    """Tables of ``schema`` sorted by ``order``, whose first name is the time, in spans of ``span``; ``sums`` are kept in the index."""

    def __init__(
        self, handle: StatefulProcessorHandle, name: str, schema: pa.Schema, order: list[str], span: int, sums: tuple[str, ...] = ()
    ) -> None:
        self.schema, self.order, self.span, self.sums = schema, order, span, sums
        self.blobs = handle.getMapState(name, "span long", "rows binary")
        self.stored = handle.getValueState(f"{name}_index", "entries binary")
        self.index = np.empty((0, 2 + len(sums)), np.int64)

    def open(self) -> None:
        """Load the index; every call on a key begins with it."""
        held = bytes(self.stored.get()[0]) if self.stored.exists() else b""
        self.index = np.frombuffer(held, np.int64).reshape(-1, 2 + len(self.sums)).copy()

    def save(self) -> None:
        if len(self.index):
            self.stored.update((self.index.tobytes(),))
        elif self.stored.exists():
            self.stored.clear()

    def clear(self) -> None:
        self.blobs.clear()
        self.index = self.index[:0]

    @property
    def spans(self) -> np.ndarray:
        return self.index[:, 0]

    @property
    def rows(self) -> np.ndarray:
        return self.index[:, 1]

    def add(self, rows: pa.Table) -> None:
        """Put rows into their spans."""
        rows = rows.sort_by([(c, "ascending") for c in self.order])
        spans = rows.column(self.order[0]).to_numpy() // self.span
        cuts = [0, *(np.flatnonzero(np.diff(spans)) + 1).tolist(), len(spans)]
        for first, last in zip(cuts, cuts[1:]):
            if last == first:
                continue
            part, span = rows.slice(first, last - first), int(spans[first])
            if span in self.spans:
                part = pa.concat_tables([self._load(span), part]).sort_by([(c, "ascending") for c in self.order])
            self._put(span, part)

    def _load(self, span: int) -> pa.Table:
        return pa.ipc.open_stream(bytes(self.blobs.getValue((span,))[0])).read_all()

    def _put(self, span: int, rows: pa.Table) -> None:
        self.blobs.updateValue((span,), (_packed(rows),))
        entry = [span, len(rows), *(int(np.sum(rows.column(c).to_numpy())) for c in self.sums)]
        others = self.index[self.spans != span]
        place = int(np.searchsorted(others[:, 0], span))
        self.index = np.insert(others, place, entry, axis=0)

    def read(self, first: int, last: int) -> pa.Table:
        """The rows of the spans from ``first`` to ``last``, in order."""
        parts = [self._load(int(s)) for s in self.spans[(self.spans >= first) & (self.spans <= last)]]
        return pa.concat_tables(parts) if parts else self.schema.empty_table()

    def first_from(self, time: int) -> int | None:
        """The earliest row's time that isn't before a time."""
        for span in self.spans[(self.spans + 1) * self.span > time]:
            at = self._load(int(span)).column(self.order[0]).to_numpy()
            place = int(np.searchsorted(at, time))
            if place < len(at):
                return int(at[place])
        return None

    def drop_before(self, span: int) -> None:
        for gone in self.spans[self.spans < span]:
            self.blobs.removeKey((int(gone),))
        self.index = self.index[self.spans >= span]

    def keep_from(self, span: int, rows: pa.Table) -> None:
        """Forget the spans before one, and leave in that one the given rows."""
        self.drop_before(span + 1)
        self.blobs.removeKey((span,))
        self.index = self.index[self.spans != span]
        if len(rows):
            self._put(span, rows)
