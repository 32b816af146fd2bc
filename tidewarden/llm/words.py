"""Words, hashes and small helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

# What separates words: space, tab, line feed, vertical tab, form feed, carriage return.
WORD_BREAK = r"[\x20\x09-\x0D]+"


def words_of(text: Column) -> Column:
    """The words of a text as an array, in order; no words for a null text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_BREAK), "")


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """A column of texts as UTF-8 bytes; a null text is empty."""
    column = pc.fill_null(batch.column(batch.schema.get_field_index(name)).cast(pa.large_binary()), b"")
    return column.to_pylist()


def word_spans(texts: pa.Array) -> tuple[np.ndarray, pa.DictionaryArray]:
    """Every word of a batch of texts: the row it stands in and its dictionary-encoded value."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    flat = lists.flatten()
    rows = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
    filled = pc.greater(pc.binary_length(flat), 0)
    return rows[filled.to_numpy(zero_copy_only=False)], flat.filter(filled).dictionary_encode()


def hashes_of(dictionary: pa.Array, seed: int = 0) -> np.ndarray:
    """The 64-bit hash of each distinct word."""
    values = dictionary.cast(pa.large_binary()).to_pylist()
    return np.fromiter((xxh64_intdigest(v, seed) for v in values), np.uint64, len(values))


def slices(batch: pa.RecordBatch, max_bytes: int, name: str = "text") -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about ``max_bytes`` of text, at least one row each.

    Pieces are copies: some Arrow functions, lower-casing among them, misread an array that begins inside a buffer.
    """
    sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(name)).cast(pa.large_binary())), 0)
    part = (np.cumsum(sizes.to_numpy(zero_copy_only=False)) - 1).clip(0) // max_bytes
    cuts = np.flatnonzero(np.diff(part)) + 1
    for start, stop in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
        if stop - start == batch.num_rows > 0:
            yield batch
        elif stop > start:
            yield batch.take(pa.array(np.arange(start, stop)))


def mixed(values: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the finishing step of a common integer hash)."""
    v = values ^ (values >> np.uint64(33))
    v = v * np.uint64(0xFF51AFD7ED558CCD)
    v ^= v >> np.uint64(33)
    v = v * np.uint64(0xC4CEB9FE1A85EC53)
    return v ^ (v >> np.uint64(33))


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a batch of texts in one array, and where each text starts (one place more than texts)."""
    whole = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(whole.buffers()[1], np.int64)[whole.offset : whole.offset + len(whole) + 1] if len(whole) else np.zeros(1, np.int64)
    held = whole.buffers()[2]
    data = np.frombuffer(held, np.uint8)[offsets[0] : offsets[-1]] if held is not None else np.empty(0, np.uint8)
    return data, offsets - offsets[0]


def texts_from(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """The texts again, of bytes of the same places."""
    return pa.LargeStringArray.from_buffers(
        len(offsets) - 1, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(data)))


def packed_rows(docs: DataFrame, **columns: Column) -> DataFrame:
    """``row`` holds all columns of ``docs``, beside the named ones: no name can clash with a column of the input."""
    return docs.select(F.struct("*").alias("row"), *[c.alias(n) for n, c in columns.items()])
