"""Document fingerprints by context-triggered piecewise hashing, compared by edit distance.

A rolling hash over seven bytes cuts a text wherever it is ``size - 1`` modulo the block size, so a cut depends on
the seven bytes before it alone and an edit changes only the pieces near it. Each piece gives one of 64 characters.
The block size is 3 times a power of two, the smallest that could give about 64 pieces, halved while it gives fewer
than 32. A fingerprint reads ``size:signature:signature at twice the size``; two are compared where their block
sizes agree, once or doubled.

The likeness of two signatures is one minus their edit distance (insertions and deletions) over their joint length,
taken as 0 unless they share a run of characters: a quarter of the shorter signature's length, between 1 and 7.
Everything is computed on arrays: pieces from running sums of a polynomial hash, edit distances for all pairs of a
batch at once with a 64-bit word for each signature.

Defined cases: a null text is an empty one, whose fingerprint is ``3::``; equal fingerprints have likeness 1, an
empty signature has likeness 0 to another. The next document follows in the order of (id, text hash); null ids come
first; after the last comes the first. Rows that repeat an id each get a row, and rows alike in id and text follow each
other. Very long texts are hashed whole. An empty table gives no rows; a single document comes after itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewarden.session import materialize

SPAN = 7
SMALLEST = 3
LONGEST = 64
ALPHABET = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
# Texts of about this many bytes form one range of ids, the unit of work; small inputs are cut into this many.
RANGE = 128 << 20
MIN_RANGES = 32
# Characters that are compared at once.
STEP = 4 << 20
RESULT = {
    "doc_id": "long", "n_chars": "long", "edited_sha256": "string", "fingerprint": "string", "edited_fingerprint": "string",
    "near_edited": "double", "near_next": "double",
}
ODD = 0x5851F42D4C957F2D
INVERSE = pow(ODD, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """1, base, base**2, ... in 64-bit arithmetic, at least ``n`` of them."""
    held = _POWERS.get(base)
    if held is None or len(held) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        held = np.full(size, base, np.uint64)
        held[0] = 1
        _POWERS[base] = held = np.multiply.accumulate(held)
    return held[:n]


def _rolling(data: np.ndarray) -> np.ndarray:
    """At each byte, a hash of it and the six before it."""
    padded = np.concatenate((np.zeros(SPAN - 1, np.uint32), data.astype(np.uint32)))
    total = np.zeros(len(data), np.uint32)
    for k in range(SPAN):
        total *= np.uint32(0x01000193)
        total += padded[k : k + len(data)] + np.uint32(1)
    total ^= total >> np.uint32(15)
    total *= np.uint32(0x2C1B3C6D)
    return total ^ (total >> np.uint32(12))


def _pieces(ends: np.ndarray, sums: np.ndarray, n: int) -> bytes:
    """One character for each piece that ends (exclusively) at ``ends``, and for what follows the last one."""
    bounds = np.concatenate(([0], ends, [n] if not len(ends) or ends[-1] != n else [])).astype(np.int64)
    if len(bounds) > LONGEST + 1:  # the last character stands for all the rest
        bounds = np.concatenate((bounds[:LONGEST], bounds[-1:]))
    value = (sums[bounds[1:]] - sums[bounds[:-1]]) * _powers(INVERSE, n + 1)[bounds[:-1]]
    value ^= value >> np.uint64(29)
    value *= np.uint64(0xBF58476D1CE4E5B9)
    return ALPHABET[(value >> np.uint64(58)).astype(np.int64)].tobytes()


def fingerprint(text: bytes) -> str:
    """``size:signature:signature at twice the size`` of a whole text."""
    n = len(text)
    if not n:
        return f"{SMALLEST}::"
    data = np.frombuffer(text, np.uint8)
    rolled = _rolling(data)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(ODD, n))))
    size = SMALLEST
    while size * LONGEST < n:
        size *= 2

    def ends(at: int) -> np.ndarray:
        return np.flatnonzero(rolled % np.uint32(at) == at - 1) + 1

    cuts = ends(size)
    while len(cuts) + 1 < LONGEST // 2 and size > SMALLEST:
        size //= 2
        cuts = ends(size)
    return f"{size}:{_pieces(cuts, sums, n).decode()}:{_pieces(ends(2 * size), sums, n).decode()}"


def _matrix(signatures: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Signatures as rows of letter numbers (-1 past the end), and their lengths."""
    sizes = np.fromiter(map(len, signatures), np.int64, len(signatures))
    flat = np.frombuffer(b"".join(s.ljust(LONGEST, b"\0") for s in signatures), np.uint8).reshape(-1, LONGEST)
    number = np.full(256, -1, np.int64)
    number[ALPHABET] = np.arange(64)
    return number[flat], sizes


def signature_likeness(left: list[bytes], right: list[bytes]) -> np.ndarray:
    """Likeness of each pair of signatures of up to 64 characters."""
    if not left:
        return np.empty(0)
    a, na = _matrix(left)
    b, nb = _matrix(right)
    pairs = np.arange(len(left))
    places = np.zeros((len(left), 65), np.uint64)  # for each letter, the places at which the left signature has it
    for k in range(LONGEST):
        letter = a[:, k]
        there = letter >= 0
        places[pairs[there], letter[there]] |= np.uint64(1 << k)
    full = np.full(len(left), np.uint64(0xFFFFFFFFFFFFFFFF))
    row = full.copy()
    runs = [np.zeros(len(left), np.uint64) for _ in range(SPAN)]
    longest = np.zeros(len(left), np.int64)
    for k in range(LONGEST):
        match = places[pairs, np.where(b[:, k] >= 0, b[:, k], 64)]
        both = row & match
        row = (row + both) | (row & ~match)
        for level in range(SPAN - 1, 0, -1):
            runs[level] = (runs[level - 1] << np.uint64(1)) & match
            longest[(runs[level] > 0) & (longest < level + 1)] = level + 1
        runs[0] = match
        longest[(match > 0) & (longest < 1)] = 1
    within = np.where(na < 64, (np.uint64(1) << np.minimum(na, 63).astype(np.uint64)) - np.uint64(1), full)
    common = np.bitwise_count(~row & within).astype(np.int64)
    total = np.maximum(na + nb, 1)
    needed = np.clip(np.minimum(na, nb) // 4, 1, SPAN)
    return np.where(longest >= needed, 2 * common / total, 0.0)


def likeness(left: list[str], right: list[str]) -> np.ndarray:
    """Likeness, 0 to 1, of each pair of fingerprints, at the block sizes that they share."""
    best = np.zeros(len(left))
    lists: tuple[list, list, list] = ([], [], [])
    for i, (x, y) in enumerate(zip(left, right)):
        if x == y:
            best[i] = 1.0
            continue
        (s, a1, a2), (t, b1, b2) = x.split(":"), y.split(":")
        s, t = int(s), int(t)
        shared = [(a1, b1), (a2, b2)] if s == t else [(a1, b2)] if s == 2 * t else [(a2, b1)] if t == 2 * s else []
        for a, b in shared:
            lists[0].append(i)
            lists[1].append(a.encode())
            lists[2].append(b.encode())
    found = signature_likeness(lists[1], lists[2])
    np.maximum.at(best, np.array(lists[0], np.int64), found)
    return best


def fingerprint_of(text: str | Column) -> Column:
    """The fingerprint of a text column."""

    @F.arrow_udf("string")
    def compute(texts: pa.Array) -> pa.Array:
        return pa.array([fingerprint(t or b"") for t in texts.cast(pa.large_binary()).to_pylist()], pa.string())

    return compute(text)


def _edited(text: str, after: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def _ranges(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``doc_id``, ``text`` and ``part``: all rows in the order of (id, text hash), cut into ranges of about ``RANGE`` bytes.

    The bounds are sampled by the exchange, so neither the plan nor a row's work grows with their number. Rows that are
    alike in id and text are ordered by where they were read, so no number of copies makes a range large.
    """
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    total = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    keys = ["doc_id", "twin", "place"]
    keyed = slim.withColumn("twin", F.xxhash64("text")).withColumn("place", F.monotonically_increasing_id())
    ordered = keyed.repartitionByRange(max(MIN_RANGES, -(-total // RANGE)), *keys).sortWithinPartitions(*keys)
    return ordered.select("doc_id", "text", F.spark_partition_id().alias("part"))


def _compared(pairs: list[tuple]) -> list[pa.Array]:
    """The columns of ``RESULT`` for rows (id, text, fingerprint), each with the row after it."""
    edited = [_edited(a[1], b[1]).encode() for a, b in pairs]
    own, changed = [a[2] for a, _ in pairs], [fingerprint(e) for e in edited]
    return [
        pa.array([a[0] for a, _ in pairs], pa.int64()), pa.array([len(a[1]) for a, _ in pairs], pa.int64()),
        pa.array([hashlib.sha256(e).hexdigest() for e in edited], pa.string()), pa.array(own, pa.string()), pa.array(changed, pa.string()),
        pa.array(likeness(own, changed)), pa.array(likeness(own, [b[2] for _, b in pairs])),
    ]


def _within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The results of one range but for its last row, and its two ends: the texts of its first and of its last row."""
    names, held = [*RESULT, "part", "first", "last"], None

    def finished(pairs: list[tuple]) -> pa.RecordBatch:
        none = [pa.nulls(len(pairs), t) for t in (pa.int32(), pa.string(), pa.string())]
        return pa.RecordBatch.from_arrays(_compared(pairs) + none, names)

    def end(doc: int | None, part: int, first: str | None, last: str | None) -> pa.RecordBatch:
        none = [pa.nulls(1, pa.string() if kind == "string" else pa.float64() if kind == "double" else pa.int64()) for kind in RESULT.values()]
        return pa.RecordBatch.from_arrays(
            [pa.array([doc], pa.int64()), *none[1:], pa.array([part], pa.int32()), pa.array([first], pa.string()), pa.array([last], pa.string())],
            names)

    for batch in batches:
        pairs, size = [], 0
        for doc, value, part in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "text", "part")]):
            row = (doc, value, fingerprint(value.encode()))
            if held is None:
                yield end(None, part, value, None)
            else:
                pairs.append((held, row))
                size += len(value)
            held, place = row, part
            if size > STEP:
                yield finished(pairs)
                pairs, size = [], 0
        if pairs:
            yield finished(pairs)
    if held is not None:
        yield end(held[0], place, None, held[1])


def _between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The results of rows whose next document begins another range."""
    for batch in batches:
        for doc, last, first in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "last", "first")]):
            pair = ((doc, last, fingerprint(last.encode())), (None, first, fingerprint(first.encode())))
            yield pa.RecordBatch.from_arrays(_compared([pair]), list(RESULT))


def compare_with_edits(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """For each document, its fingerprint, that of its text with the second half taken from the next document's
    start, and the likeness to both that text and the next document.

    Texts are dealt once, by ranges of the order. A range finishes all its rows but the last, and writes the texts of its
    first and last row, which are joined to their neighbours: two texts a range are all that moves again.
    """
    schema = ", ".join(f"{name} {kind}" for name, kind in RESULT.items())
    written = materialize(_ranges(docs, doc_id, text).mapInArrow(_within, f"{schema}, part int, first string, last string"))
    heads = written.filter("first is not null").select(F.col("part").alias("next"), "first")
    # one number for each range; after the last range comes the first
    after = F.coalesce(F.lead("part").over(Window.orderBy("part")), F.min("part").over(Window.partitionBy()))
    tails = written.filter("last is not null").select("part", "doc_id", "last")
    follows = tails.select("part").withColumn("next", after)
    ends = tails.join(follows, "part").join(heads, "next").select("doc_id", "last", "first")
    inner = written.filter("edited_sha256 is not null").select(*RESULT)
    return inner.unionByName(ends.mapInArrow(_between, schema))
